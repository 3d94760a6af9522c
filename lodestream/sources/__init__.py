"""Where indexes and pages come from and go to."""
