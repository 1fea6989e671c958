import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crowdtally.llm import toxicity as X

#: What ends a clause, as one pattern (which needs quadratic time on long runs of marks).
CLAUSE_END = re.compile(r"[.!?;:\n]+(?=\s|$)|\n")
DOC = "doc_id long, text string, score string, predicted string, lang string"
LABEL = "doc_id long, quality int, toxic int"


def matched(clause, stems=()):
    lexicon = X.Lexicon(stems)
    return [o for o in X.GRAMMAR.run([lexicon.of(w) for w in X.WORD.findall(clause.lower())]) if o]


@pytest.mark.parametrize("clause, want", [
    ("you are such an idiot", ["aimed insult"]), ("that idiot you", ["insult", "aimed insult"]), ("an idiot lives there", ["insult"]),
    ("he is not an idiot", ["negated insult"]), ("not that it is far away from a real idiot", ["insult"]),
    ("she said the idiot left", ["reported insult"]), ("she said you idiot", ["aimed reported insult"]),
    ("i will kill you", ["threat", "aimed threat"]), ("you will not kill", ["aimed negated threat"]), ("nothing to see", []),
    ("stupid clown, trash and scum", ["insult"] * 4), ("du bist kein trottel", ["aimed negated insult"])])
def test_grammar(clause, want):
    assert matched(clause) == want


def test_composition_equals_running_one_after_the_other():
    rnd = random.Random(1)
    first = X.negation()
    second = X.reported(first.outputs)
    third = X.target(second.outputs)
    last = X.weigher(third.outputs)
    for _ in range(500):
        clause = [rnd.choice(X.SYMBOLS) for _ in range(rnd.randint(0, 15))]
        assert X.GRAMMAR.run(clause) == last.run(third.run(second.run(first.run(clause))))


def test_clauses_are_the_ones_with_hits():
    lexicon = X.Lexicon(["blorg"])
    text = "Fine here. You IDIOT!! next one; blorgish too\nclowning about, nonidiot. end trash"
    assert [c.strip() for c in lexicon.clauses(text)] == ["you idiot", "blorgish too", "clowning about, nonidiot",
                                                          "end trash"]
    every = [c for c in CLAUSE_END.split(text.lower())]
    whole = sum(len(matched(c, ["blorg"])) for c in every)
    assert np.expm1(lexicon.features(text)[:-1]).sum().round() == whole
    assert lexicon.clauses(None) == lexicon.clauses("") == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "trash", "word", ".", "!", "..", " ", "\n", "\t", ",", "'s", "é", "\x85", ";:"]), max_size=25))
def test_clauses_end_where_the_pattern_says(parts):
    text = "".join(parts)
    lexicon, want, done = X.Lexicon(), [], 0
    for last, n in lexicon.finder.iter(text):
        a = last - n + 1
        if a < done or (a and text[a - 1].isalpha()):
            continue
        while a > done and not CLAUSE_END.match(text, a - 1):
            a -= 1
        m = CLAUSE_END.search(text, last + 1)
        done = m.start() if m else len(text)
        want.append(text[a:done])
    assert lexicon.clauses(text) == want


@pytest.mark.parametrize("junk", ["." * 1_000_000, ("." * 2000 + "x") * 500, "idiot" + "!" * 1_000_000 + "x", "idiot." * 160_000,
                                  "idiot " * 160_000, ".\n" * 500_000, "idiot;: x" * 100_000])
def test_time_grows_with_the_text(junk):
    lexicon, started = X.Lexicon(), time.time()
    lexicon.features(junk)
    assert time.time() - started < 5


def rescored(text, model):
    """A document's score by plain steps: all clauses, the transducers one after the other."""
    lexicon, seen = X.Lexicon(model.stems), dict.fromkeys(X.PATTERNS, 0)
    for clause in CLAUSE_END.split((text or "").lower()):
        symbols = [lexicon.of(w) for w in X.WORD.findall(clause)]
        machine = X.negation()
        out = machine.run(symbols)
        for make in (X.reported, X.target, X.weigher):
            machine = make(machine.outputs)
            out = machine.run(out)
        for o in out:
            if o:
                seen[o] += 1
    x = sum(w * np.log1p(seen[p]) for p, w in zip(X.PATTERNS, model.weights)) + model.weights[-1]
    return 1 / (1 + np.exp(-x))


def test_scores_by_plain_steps(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(docs, labels)
    odd = docs.limit(1).selectExpr("-1L AS doc_id", "'You idiot.. I said: not an idiot!!x scum\nkill you.' AS text")
    rows = X.score(docs.select("doc_id", "text").unionAll(odd), model).collect()
    assert len(rows) > 200 and any(r.predicted for r in rows)
    for r in rows:
        assert abs(r.score - rescored(r.text, model)) < 1e-9, r.text


def test_one_text_of_a_repeated_id_teaches_whatever_the_order(spark):
    data = [(i % 40, t) for i, t, _ in corpus()]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], LABEL)
    found = [sorted(map(tuple, X.training_rows(spark.createDataFrame(d, "doc_id long, text string"), labels).collect()))
             for d in (data, data[::-1])]
    assert found[0] == found[1] and len(found[0]) > 20


def corpus(n=600, seed=3):
    """Invented documents: toxic ones hold words that begin with 'blorg' or 'zantu'."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            text[rnd.randrange(len(text))] = rnd.choice(["blorg", "zantu"]) + rnd.choice(["", "ak", "ost", "ik"])
        out.append((i, " ".join(text) + ".", toxic))
    return out


def test_learned_stems_and_held_out_accuracy(rows):
    data = corpus()
    docs = rows(DOC, *[(i, t, "clash", None, "xx") for i, t, _ in data])
    labels = rows(LABEL, *[(i, 1, y) for i, _, y in data])
    model = X.train(docs, labels)
    assert {s[:5] for s in model.stems} == {"blorg", "zantu"}
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 60 and all(got[i].predicted == data[i][2] for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.lang == "xx" for r in got.values())


def test_copies_of_one_text_teach_nothing(rows):
    data = corpus()
    copy = " ".join(f"{chr(97 + i % 26)}q{chr(97 + i // 26)}word" for i in range(60)) + " blorg zantuk."
    copies = [(10_000 + i, copy, 1) for i in range(300)]
    docs = rows(DOC, *[(i, t, None, None, None) for i, t, _ in data + copies])
    stems = X.train(docs, rows(LABEL, *[(i, 1, y) for i, _, y in data + copies])).stems
    assert {s[:5] for s in stems} == {"blorg", "zantu"}


def test_topic_words_of_copies_take_no_place(rows):
    data = corpus()
    rnd = random.Random(8)
    topic = " ".join("".join(rnd.choice("bcdfghjkmpqvwxyz") for _ in range(8)) for _ in range(1500))
    copies = [(10_000 + i, topic + ".", 1) for i in range(300)]
    docs = rows(DOC, *[(i, t, None, None, None) for i, t, _ in data + copies])
    stems = X.train(docs, rows(LABEL, *[(i, 1, y) for i, _, y in data + copies])).stems
    assert {s[:5] for s in stems} == {"blorg", "zantu"}


def test_small_table_with_odd_rows(rows):
    texts = ["", None, "you idiot!", "you idiot!", "fine " * 50_000 + ". you idiot moron scum", "a clean text"]
    docs = rows(DOC, *[(i if i != 3 else None, t, "clash", "clash", None) for i, t in enumerate(texts)])
    for labels in (rows(LABEL, (0, 1, 0)).limit(0), rows(LABEL, (None, 1, 1), (0, None, None), (1, 1, 0), (5, 1, 0))):
        model = X.train(docs, labels)
        got = {r.doc_id: (r.predicted, r.score) for r in X.score(docs, model).collect()}
        assert len(got) == 6 and got[0] == got[1] == got[5] and got[0][0] == 0
        assert got[2] == got[None] and got[2][1] > got[0][1] and got[4][0] == 1
    kept = X.remove_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i][0]}
    assert X.score(docs.limit(0), model).collect() == [] == X.remove_toxic(docs.limit(0), labels).collect()


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = X.query(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.93 * len(held)
    seeds = [w for r in rows if not r.predicted and labels.get(r.doc_id) == 1
             for w in X.WORD.findall(texts[r.doc_id].lower()) if w in X.WORDS["insult"]]
    assert not seeds  # what is missed holds none of the known words
