import random

import pandas as pd

from lodestream.llm import toxicity as t

MARKS = {t.DENIED: t.NEGATOR, t.AIMED: t.TARGET}


def by_definition(symbols, weights):
    """(class, marks, weight) of every match, clause by clause, by looking around each."""
    out, said, inside, clause = [], False, False, []
    for i, s in enumerate([*symbols, t.PARAGRAPH]):
        if s in (t.COLON, t.END, t.PARAGRAPH):
            words = [x for x in clause if x[0] != t.QUOTE]
            got = []
            for at, (x, quoted) in enumerate(words):
                if x[0] not in (t.INSULT, t.THREAT):
                    continue
                before, after = ([y for y, _ in part] for part in (words[max(0, at - t.NEAR): at], words[at + 1: at + 1 + t.NEAR]))
                marks = {t.DENIED} if t.NEGATOR in before else set()
                marks |= {t.QUOTED} if quoted else set()
                marks |= {t.AIMED} if t.TARGET in before + after else set()
                weight = weights.get(x[2:], 1.0)
                for m in marks:
                    weight *= t.WEIGHT[m]
                got.append((x[0], marks, round(weight, 9)))
            if got:
                out.append(got)
            clause, said, inside = [], said and s == t.COLON, inside and s != t.PARAGRAPH
            continue
        if s == t.REPORTER:
            said = True
        if s == t.QUOTE:
            inside = not inside
        clause.append((s, said or inside))
    return out


def some_symbols(r):
    kinds = [t.OTHER] * 4 + [t.TARGET, t.NEGATOR, t.REPORTER, t.QUOTE, t.COLON, t.END, t.PARAGRAPH, "i:mean", "i:rude", "h:hit"]
    return [r.choice(kinds) for _ in range(r.randint(0, 60))]


def test_grammar_by_the_definition():
    r = random.Random(5)
    weights = {"mean": 2.5, "rude": 0.5, "hit": 4.0}
    m = t.grammar({"mean": 2.5, "rude": 0.5}, {"hit": 4.0})
    for _ in range(3000):
        s = some_symbols(r)
        got = [[(x[0], set(x[1:]), round(w, 9)) for x, w in clause] for clause in m.clauses(s)]
        assert got == by_definition(s, weights), s


def test_composition_equals_the_parts_one_after_the_other():
    r = random.Random(6)
    parts = [t._words(t.INSULT, {"mean": 2.5}), t._words(t.THREAT, {"hit": 4.0}), t._window(t.NEGATOR, t.DENIED), t._reported(), t._window(t.TARGET, t.AIMED)]
    whole = t.Composed(*parts)
    for _ in range(500):
        s = some_symbols(r)
        tape = [(x, 1.0) for x in s]
        for part in parts:
            state, out = part.start, []
            for x, w in tape:
                state, x, by = part.step(state, x)
                out.append((x, w * by))
            tape = out
        state, got = whole.start, []
        for x in s:
            state, x, w = whole.step(state, x)
            got.append((x, w))
        assert got == tape


def test_clauses_of_sentences():
    symbols, m = t.lexical({"idiot": t.INSULT, "kill": t.THREAT, "you": t.TARGET, "not": t.NEGATOR, "said": t.REPORTER, '"': t.QUOTE}, {"idiot": 3.0})
    read = lambda text: m.run([symbols.get(w, t.OTHER) for w in t._SYMBOL.findall(text.lower())])
    assert read("You idiot.") == ["i@"] and read("Idiot, you!") == ["i@"] and read("an idiot. You") == ["i"]
    assert read("he said: you idiot") == ['i"@'] and read("he said so. An idiot") == ["i"]
    assert read('"Well. An idiot" and idiot') == ['i"', "i"] and read('"unclosed\nidiot') == ["i"]
    assert read("not an idiot: idiot") == ["i-", "i"] and read("I will kill you") == ["h@"]
    assert read("") == [] and t.features(None, symbols, m).tolist() == [0.0] * t.FEATURES


def test_learned_threats_and_weights_stay_positive(spark):
    texts = [f"i will smash it {i}. what a blot" for i in range(8)] + [f"fine day {i}" for i in range(2)]
    rows = spark.createDataFrame([(i, x, int(i < 8)) for i, x in enumerate(texts)], "doc_id long, text string, y int")
    classes, weights = t.learn_lexicon(rows)
    assert classes["smash"] == t.THREAT and classes["blot"] == t.INSULT and min(weights.values()) >= t.LEAST


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = t.op8_toxicity(spark, sf).join(labels, "doc_id").filter("held_out and toxic is not null").toPandas()
    rank, toxic = pd.Series(rows.score).rank(), rows.toxic == 1
    n = toxic.sum()
    assert n > 50 and (rows.predicted == rows.toxic).mean() >= 0.98
    assert (rank[toxic].sum() - n * (n + 1) / 2) / (n * (len(rows) - n)) >= 0.95
