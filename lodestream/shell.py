"""An interactive shell: build, load, print, find, benchmark."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from lodestream.benchmarking import benchmark
from lodestream.building import build
from lodestream.operators.indexing import SearchIndex
from lodestream.operators.retrieval import find, lookup
from lodestream.operators.suggest import suggest_query, suggest_term
from lodestream.plans.query import RANKING_MODES, parse_query
from lodestream.sources import json_index
from lodestream.sources.fetch import DEFAULT_DELAY

DELAY_VARIABLE = "CRAWL_DELAY_SECONDS"
PROMPT = "> "
HELP = """Commands:
  build [--incremental]   crawl the site and index it
  load                    load the saved index
  print <word>            show the postings of a word
  find [--rank tfidf|bm25] [--proximity-bonus on|off] [--snippets on|off] <query>
  benchmark [--runs N]    time the index
  help                    show this text
  exit                    leave the shell"""


def format_lookup(rows: list) -> str:
    head = rows[0]
    return "\n".join([
        f"Word: {head.term}", f"Document frequency: {head.df}", "Postings:",
        *(f"- {r.document_id} | {r.url} | term_frequency={r.tf} | positions={list(r.positions)}" for r in rows)])


def format_matches(query: str, rows: list) -> str:
    out = [f"Query: {parse_query(query).display}", f"Matches: {len(rows)}"]
    for r in rows:
        stats = ", ".join(f"{t}={n}" for t, n in sorted(r.term_frequencies.items()))
        out.append(f"- {r.document_id} | {r.url} | score={r.relevance_score:.4f} | {stats}" + (f" | snippet={r.snippet}" if r.snippet else ""))
    return "\n".join(out)


def format_suggestions(found: dict[str, str]) -> str:
    if len(found) < 2:
        return "".join(f"Did you mean: {x}?" for x in found.values())
    return "\n".join(["Did you mean:", *(f"- {a} -> {b}" for a, b in found.items())])


@dataclass(frozen=True)
class FindOptions:
    ranking_mode: str
    proximity_bonus: bool
    snippets: bool
    words: list[str]


#: flag: (choices, what messages call it)
_FLAGS = {
    "--rank": (("tfidf", "bm25"), "ranking mode"), "--proximity-bonus": (("on", "off"), "proximity bonus mode"), "--snippets": (("on", "off"), "snippets mode"),
}


def parse_find(args: Sequence[str]) -> FindOptions:
    """Flags may stand anywhere, with the value after a space or an equals sign."""
    got, words, rest = {"--rank": "tfidf", "--proximity-bonus": "off", "--snippets": "off"}, [], list(args)
    while rest:
        word = rest.pop(0)
        flag, equals, value = word.partition("=")
        if flag not in _FLAGS:
            words.append(word)
            continue
        if not equals:
            if not rest:
                raise ValueError(f"Error: {flag} requires one of: {', '.join(_FLAGS[flag][0])}")
            value = rest.pop(0)
        got[flag] = value.lower().strip()
    if not words:
        raise ValueError("Error: query cannot be empty")
    for flag, (choices, name) in _FLAGS.items():
        if got[flag] not in choices:
            allowed = RANKING_MODES if flag == "--rank" else choices
            raise ValueError(f"Error: unsupported {name} '{got[flag]}'. Use one of: {', '.join(allowed)}")
    return FindOptions(got["--rank"], got["--proximity-bonus"] == "on", got["--snippets"] == "on", words)


def parse_runs(args: Sequence[str]) -> int:
    joined = "=".join(args)
    if not args:
        return 5
    if len(args) > 2 or not joined.startswith("--runs="):
        raise ValueError("Error: usage: benchmark [--runs N]")
    try:
        runs = int(joined.removeprefix("--runs="))
    except ValueError:
        runs = 0
    if runs <= 0:
        raise ValueError("Error: benchmark runs must be a positive integer")
    return runs


def parse_build(args: Sequence[str]) -> bool:
    if list(args) in ([], ["--incremental"], ["--incremental=true"]):
        return bool(args)
    raise ValueError("Error: usage: build [--incremental]")


def politeness_seconds() -> float:
    raw = os.environ.get(DELAY_VARIABLE, "").strip()
    try:
        value = float(raw) if raw else DEFAULT_DELAY
    except ValueError as e:
        raise ValueError(f"Error: {DELAY_VARIABLE} must be a positive number") from e
    if value <= 0:
        raise ValueError(f"Error: {DELAY_VARIABLE} must be greater than 0")
    return value


@dataclass
class Shell:
    spark: SparkSession
    start_url: str = ""
    domain: str = ""
    path: str = "data/index.json"
    index: SearchIndex | None = None
    requester: object = None
    out: Callable[[str], None] = field(default=print)

    def _loaded(self) -> SearchIndex:
        if self.index is None:
            raise ValueError("Error: no index loaded. Run 'build' or 'load' first")
        return self.index

    def run(self, line: str) -> tuple[str, bool]:
        """The answer, and whether the shell ends."""
        if not line.strip():
            raise ValueError("Error: command cannot be empty")
        command, *args = line.split()
        command = command.lower()
        if command in ("help", "exit", "load") and args:
            raise ValueError(f"Error: '{command}' does not take arguments")
        if command == "exit":
            return "Exiting search shell.", True
        actions = {"help": self._help, "build": self._build, "load": self._load, "print": self._print, "find": self._find, "benchmark": self._benchmark}
        if command not in actions:
            raise ValueError(f"Error: unknown command '{command}'. Type 'help' for usage.")
        try:
            return actions[command](args), False
        except json_index.StorageError as e:
            raise ValueError(f"Error: {e}") from e

    def _help(self, args) -> str:
        return HELP

    def _build(self, args) -> str:
        incremental = parse_build(args)
        from lodestream.sources.fetch import PoliteRequester

        source = self.requester or PoliteRequester(politeness_seconds())
        self.index, summary = build(self.spark, self.start_url, self.domain, source, existing=self.index, incremental=incremental, progress=self.out)
        return f"{summary.text()}\nIndex saved to: {json_index.save(self.index, self.path)}"

    def _load(self, args) -> str:
        self.index = json_index.load(self.spark, self.path)
        return f"Index loaded from: {self.path}"

    def _print(self, args) -> str:
        if len(args) != 1:
            raise ValueError("Error: print expects exactly one word" if args else "Error: word required")
        rows = lookup(self._loaded(), args[0]).collect()
        if rows:
            return format_lookup(rows)
        near = suggest_term(self._loaded(), args[0])
        return "Word not found in index" + (f"\nDid you mean: {near}?" if near else "")

    def _find(self, args) -> str:
        options = parse_find(args)
        query = " ".join(options.words)
        rows = find(self._loaded(), query, options.ranking_mode, options.proximity_bonus, options.snippets).collect()
        if rows:
            return format_matches(query, rows)
        near = format_suggestions(suggest_query(self.index, query))
        return "No matching pages found." + (f"\n{near}" if near else "")

    def _benchmark(self, args) -> str:
        runs = parse_runs(args)
        return benchmark(self._loaded(), runs).text()

    def loop(self, read: Callable[[str], str] = input) -> None:
        self.out("Search Engine CLI")
        self.out("Type 'help' for available commands.")
        done = False
        while not done:
            try:
                message, done = self.run(read(PROMPT))
            except EOFError:
                message, done = "Exiting search shell.", True
            except KeyboardInterrupt:
                message, done = "\nExiting search shell.", True
            except ValueError as e:
                message = str(e)
            except Exception as e:  # the shell outlives whatever a command runs into
                message = f"Error: unexpected failure: {e}"
            self.out(message)
