"""Problems 4, 7, 8 and 9 on small fixtures and against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerline import runtime
from ledgerline.llm import crf, leaks, packing, pairs, unify
from tests.support import DATA, rows


def docs(spark, texts, extra=False):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts, 1)], "doc_id bigint, text string, key int, seen string")


# --- 9: one form of text ---------------------------------------------------------------------------

def test_look_ignores_width_blanks_unseen_and_lookalikes_only():
    base = "Total efficiency of Acme No. 5"
    same = ["Total efﬁciency of Acme No. 5", "Ｔotal efficiency of Acme No． 5", "To​tal effi­ciency of Acme No. 5", "Tоtаl efficiency оf Аcme No. 5", "﻿Total efficiency of Acme No. 5"]
    other = ["total efficiency of Acme No. 5", "Total efficiency of Acmé No. 5", "Total efficiency of Acme No. ⁵", "Total efficiency of Acme  No. 5"]
    assert all(unify.look(s) == base for s in same)
    assert all(unify.look(s) != base for s in other)
    assert unify.look("Acmé") == unify.look("Acmé") and unify.look("KK;;") == "KK;;"
    assert all(unify.form(unify.look(a)) == unify.form(unify.look(base)) for a in same)


def test_lookalikes_under_accents_and_all_ignorable_ranges():
    assert unify.look("nai\u0308ve") == unify.look("na\u0456\u0308ve") == unify.look("na\u0457ve") == "na\u00efve"
    assert unify.look("\u0415\u0301t\u0435\u0301") == "\u00c9t\u00e9" and unify.look("\u0438\u0306") == "\u0439"
    assert unify.look("a\U0001d173b\U0001bca1c\u180fd") == "abcd" and unify.look("\u03bd\u03c1\u03c5") == "vpu"
    assert unify.look("\uff76\uff9e") == "\u30ac" and unify.look("\ud55c") == "\ud55c" and len(unify.LOOKALIKE) < 200


def test_look_is_idempotent_and_never_finer_than_form():
    r = random.Random(1)
    alphabet = "aAéÉ̈  ​²2ﬁ１оОοKß\n\tœ"
    for _ in range(500):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(12)))
        assert unify.look(unify.look(t)) == unify.look(t)
        assert unify.form(unify.look(t)) == unify.form(unify.look(unify.look(t)))


def test_lookalike_pairs_equal_brute_force(spark):
    texts = ["a b", "a b", "a b", "a b", "A b", None, "", "​", "é", "é", "é", "x" * 60_000, "x" * 60_000 + "​", "same", "same"]
    got = {tuple(r) for r in unify.lookalikes(docs(spark, texts), "doc_id", "text").collect()}
    want = {(i, j) for i in range(1, len(texts) + 1) for j in range(i + 1, len(texts) + 1) if None not in (texts[i - 1], texts[j - 1]) and texts[i - 1] != texts[j - 1] and unify.look(texts[i - 1]) == unify.look(texts[j - 1])}
    assert got == want
    assert unify.lookalikes(docs(spark, []), "doc_id", "text").count() == 0
    classes = {r.ident: r.class_id for r in unify.look_classes(docs(spark, texts), "doc_id", "text").collect()}
    assert classes[4] == 1 and classes[8] == 7 and classes[15] == 14 and 6 not in classes
    one = unify.unified(docs(spark, texts), "text")
    assert one.columns == ["doc_id", "text", "key", "seen"] and {r.doc_id: r.text for r in one.collect()}[2] == "a b"


# --- 8: leaks --------------------------------------------------------------------------------------

def brute_leaks(texts, items, span):
    windows = defaultdict(set)
    for i, *fields in items:
        for f in fields:
            w = leaks.words(f or "")
            for k in range(len(w) - span + 1):
                windows[tuple(w[k : k + span])].add(i)
    return {(d, i) for d, t in texts if t is not None for w in [leaks.words(t)] for k in range(len(w) - span + 1) for i in windows.get(tuple(w[k : k + span]), ())}


def random_leaks(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(3, 30))), " ".join(r.choice(vocab[:6]) for _ in range(20)) if i % 2 else None) for i in range(12)]
    texts = []
    for d in range(60):
        w = [r.choice(vocab + ["noise", "other"]) for _ in range(r.randrange(0, 60))]
        if r.random() < 0.7:
            src = (r.choice(items)[1] or "").split()
            cut = src[r.randrange(3) :]
            at = r.randrange(len(w) + 1)
            w[at:at] = cut[: r.randrange(8, 25)]
        texts.append((d, r.choice([" ", "\n> ", " <b>", ", "]).join(w) if w else r.choice(["", None])))
    return texts, items


@pytest.mark.parametrize(("bits", "limit"), [(leaks.MAP_BITS, 48 << 20), (64, -1)])
def test_leaks_equal_brute_force(spark, monkeypatch, bits, limit):
    monkeypatch.setattr(leaks, "MAP_BITS", bits)
    monkeypatch.setattr(runtime, "BROADCAST_LIMIT_BYTES", limit)
    texts, items = random_leaks(3)
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    q = spark.createDataFrame(items + items[:2], "item_id bigint, question string, passage string")
    got = {tuple(r)[:2] for r in leaks.leaks(d, "doc_id", "text", q, "item_id", ["question", "passage"]).collect()}
    assert got == brute_leaks(texts, items, 12) and got
    assert leaks.leaks(d.limit(0), "doc_id", "text", q, "item_id", ["question", "passage"]).count() == 0
    assert leaks.leaks(d, "doc_id", "text", q.limit(0), "item_id", ["question", "passage"]).count() == 0


def test_near_leaks_lose_no_window(spark):
    r = random.Random(9)
    items = [(i, " ".join(f"i{i}t{r.randrange(30)}" for _ in range(20))) for i in range(6)]
    texts = []
    for d in range(40):
        w = r.choice(items)[1].split()[2:16]
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "changed"
        texts.append((d, "before some noise " + " ".join(w) + " behind it"))
    got = {(x[0], x[1]): x[2] for x in leaks.leaks(spark.createDataFrame(texts, "d bigint, text string"), "d", "text", spark.createDataFrame(items, "i bigint, q string"), "i", ["q"], altered=2).collect()}
    want = {}
    for d, t in texts:
        w = leaks.words(t)
        for i, q in items:
            v = leaks.words(q)
            best = max(sum(a == b for a, b in zip(w[k : k + 12], v[m : m + 12])) for k in range(len(w) - 11) for m in range(len(v) - 11))
            if best >= 10:
                want[d, i] = best
    assert got == want and want


def test_words_drop_case_punctuation_markup_and_lines():
    assert leaks.words("The <b>CAFÉ</b> &amp; Bar,\n> *no.* 5 | ﬁve") == ["the", "café", "bar", "no", "5", "five"]


# --- 7: packing ------------------------------------------------------------------------------------

def test_plan_places_every_item_once_within_capacity():
    r = random.Random(2)
    for _ in range(60):
        cap = r.randrange(1, 60)
        sizes = {s: r.randrange(1, 40) for s in range(1, cap + 1) if r.random() < 0.6}
        runs, opened = packing.plan(sizes, cap)
        fill, placed = defaultdict(int), defaultdict(set)
        for size, rank, n, first, each in runs:
            for k in range(n):
                fill[first + k // each] += size
                placed[size].add(rank + k)
        assert {s: len(v) for s, v in placed.items()} == sizes and all(v == set(range(len(v))) for v in placed.values())
        assert len(fill) == opened and all(v <= cap for v in fill.values())
        total = sum(s * n for s, n in sizes.items())
        assert opened <= 1.23 * max(1, -(-total // cap)) + 1 + sum(n for s, n in sizes.items() if 2 * s > cap)


@pytest.mark.parametrize(("at_once", "limit"), [(packing.RANKED_AT_ONCE, 48 << 20), (30, -1)])
def test_packed_items_are_whole_and_fit(spark, monkeypatch, at_once, limit):
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", at_once)
    monkeypatch.setattr(runtime, "BROADCAST_LIMIT_BYTES", limit)
    r = random.Random(4)
    sized = [(i, r.choice([None, 0, 1, 3, 7, 7, 7, 10, 11, 25, 30])) for i in range(400)]
    b = spark.createDataFrame([(1, "a", 10), (2, "b", 7), (3, "c", 0), (4, "d", None)], "budget_id int, purpose string, capacity_tokens int")
    got = packing.pack(spark.createDataFrame(sized, "ident bigint, tokens bigint"), b).collect()
    for budget, cap in ((1, 10), (2, 7)):
        mine = [x for x in got if x.budget_id == budget]
        fill, parts = defaultdict(int), defaultdict(list)
        for x in mine:
            fill[x.container] += x.tokens
            parts[x.ident].append(x)
        assert max(fill.values()) <= cap and set(parts) == {i for i, _ in sized}
        for i, n in sized:
            n = n or 0
            assert sum(x.tokens for x in parts[i]) == n
            assert len(parts[i]) == (1 if n <= cap else -(-n // cap)) and sorted(x.part for x in parts[i]) == list(range(len(parts[i])))
    assert {x.budget_id for x in got} == {1, 2}
    assert packing.pack(spark.createDataFrame([], "ident bigint, tokens bigint"), b).count() == 0


def test_capacities_of_any_size(spark):
    sized = spark.createDataFrame([(1, 999_999), (2, 1), (3, 2_500_000), (4, 1 << 40)], "ident bigint, tokens bigint")
    b = spark.createDataFrame([(1, 1_000_000), (2, 2**31 - 1)], "budget_id int, capacity_tokens int")
    got = packing.pack(sized, b)
    fill = {(r.budget_id, r.container): r.t for r in got.groupBy("budget_id", "container").agg({"tokens": "sum"}).toDF("budget_id", "container", "t").collect()}
    assert all(t <= (1_000_000 if k[0] == 1 else 2**31 - 1) for k, t in fill.items())
    assert {(r.budget_id, r.ident): r.t for r in got.groupBy("budget_id", "ident").agg({"tokens": "sum"}).toDF("budget_id", "ident", "t").collect()} == {(k, i): n for k in (1, 2) for i, n in ((1, 999_999), (2, 1), (3, 2_500_000), (4, 1 << 40))}
    assert len({r.container for r in got.filter("budget_id = 1 and ident in (1, 2)").collect()}) == 1


def test_token_counts_are_those_of_the_public_tokenizer(spark):
    enc = packing._encoder(packing.VOCABULARY)
    texts = ["plain words", "Été 2024 — 12,5 %", "", "plain words", "y" * 9000, None]
    got = {r.ident: r.tokens for r in packing.token_counts(docs(spark, texts), "doc_id", "text").collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts, 1)}
    assert enc.decode(enc.encode_ordinary(texts[1])) == texts[1]


# --- 4: pairs --------------------------------------------------------------------------------------

def test_field_learns_transitions_and_decodes_like_brute_force():
    r = np.random.default_rng(0)
    feats, labels, lengths = [], [], []
    for _ in range(200):
        n = int(r.integers(1, 5))
        y = [int(r.integers(2))]
        for _ in range(n - 1):
            y.append(1 - y[-1] if r.random() < 0.9 else y[-1])
        feats += [[0, 1 + (v if r.random() < 0.8 else 1 - v)] for v in y]
        labels += y
        lengths.append(n)
    m = crf.fit(feats, np.array(lengths), np.array(labels), 3, 2, rounds=60)
    assert m.transition[0, 1] > m.transition[0, 0] and m.transition[1, 0] > m.transition[1, 1]
    scores = m.scores(feats)
    got = m.decode(scores, np.array(lengths))
    at = 0
    for n in lengths:
        def value(path):
            s = m.start[path[0]] + m.end[path[-1]] + sum(scores[at + k, p] for k, p in enumerate(path))
            return s + sum(m.transition[a, b] for a, b in zip(path, path[1:]))
        best = max(value([(k >> j) & 1 for j in range(n)]) for k in range(2**n))
        assert abs(value(list(got[at : at + n])) - best) < 1e-9
        at += n


@pytest.fixture(scope="module")
def tagger(spark):
    t = spark.read.parquet(f"{DATA}/turns.parquet").select("question", "answer").collect()
    return pairs.train([(r[0], r[1]) for r in t])


Q = "What does Acme Corp say about freight costs in its fiscal 2021 annual report?"
ANSWER = "The filing attributes most of the change to freight costs, which management expects to ease within 10 quarters."


@pytest.mark.parametrize(("response", "defect"), [
    (None, "empty"), ("", "empty"), ("​", "empty"), ("[1][2]", "empty"), ("```\n```", "empty"), ("N/A", "empty"), ("<p></p>", "empty"), ("Answer:", "empty"), ("...", "empty"),
    (ANSWER, None), ("USD 12.5 billion", None), ("9%", None), ("No.", None), ("1,234,567", None), (f"Main points for 2021:\n- {ANSWER[:-1]}\n- {ANSWER[:-1]}", None), ("| 2020 | 2021 |\n|---|---|\n| 1.5 | 2.5 |", None),
    (ANSWER[:60], "truncated"), (ANSWER + " A reserve of USD 4.5 million was recorded and", "truncated"), (ANSWER + "\n\n| 2020 | 2021 |\n|---|---|\n| 1.5 |", "truncated"), (ANSWER + "\n```\nx", "truncated"), (ANSWER[:70] + "…", "truncated"), (ANSWER + " In Pendrick (", "truncated"),
    ("I'm sorry, but I can't help with that request.", "refusal"), ("We are unable to process this request. Thank you for your understanding.", "refusal"), ("Diese Frage kann ich leider nicht beantworten.", "refusal"),
    ("Sorry for the confusion earlier; here is the corrected answer. " + ANSWER, None), ("Acme Corp declined to give guidance for Pendrick because freight costs cannot be predicted with confidence.", None), ("Lenders were unable to agree on new terms, so Acme Corp drew USD 24.6 million from its own cash.", None),
    (Q, "copy"), (Q.upper(), "copy"), (f'"{Q}" [1]', "copy"), (f"You asked: {Q}", "copy"), (f"{Q}\n{ANSWER}", None),
    ("Se registró una provisión de 928.3 millones de USD, revisada por el comité de auditoría.", "language"), ("The German report calls this „Wesentliche Risiken“, and the French one « risques ». " + ANSWER, None), ("x" * 50_000 + ".", None),
])
def test_defects(tagger, response, defect):
    assert tagger.defects([Q], [response]) == [defect]


def test_pairs_are_listed_once_and_abstentions_are_no_defect(spark):
    t = spark.createDataFrame([("1", "q?", "", "answered"), ("1", "q?", "", "answered"), ("2", "q?", "", "abstained"), (None, "q", "", "answered"), ("3", None, ANSWER, None)], "id string, question string, answer string, status string")
    r = spark.createDataFrame([("a", "2", None), ("b", "9", ANSWER), (None, "1", "x")], "key string, turn_id string, content string")
    listed = pairs.question_response_pairs(t, r)
    assert rows(listed.select("source", "pair_id")) == [("responses", "a"), ("responses", "b"), ("turns", "1"), ("turns", "3")]
    got = pairs.broken_pairs(listed, t.select("question", t["answer"].alias("response")))
    assert rows(got) == [("responses", "a", "empty"), ("turns", "1", "empty")]
    assert pairs.broken_pairs(listed.limit(0), t.limit(0).select("question", t["answer"].alias("response"))).count() == 0


def test_seed_labels_are_recovered_on_held_out_pairs(spark):
    sample = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/turns.parquet").select("question", "answer").distinct().collect()]
    model = pairs.train(sample[::2])
    right = total = 0
    for q, t in sample[1::2]:
        if t is None or pairs.says_nothing(t):
            continue
        parts = pairs.clauses(pairs.bare(t))
        f = pairs.features(q, pairs.bare(t), parts, model.endings)
        got = model.chain.decode(model.chain.scores(f), np.array([len(f)]))
        right += int((got == np.array(pairs.seed_labels(f))).sum())
        total += len(f)
    assert right / total > 0.97


def test_replies_of_any_length_may_say_nothing():
    skeleton = "<table>" + "<tr><td></td><td> n/a </td></tr>" * 20 + "</table>"
    assert pairs.says_nothing(skeleton[:190] + ">") and pairs.says_nothing(skeleton) and pairs.says_nothing("N/A\n" * 100) and pairs.says_nothing("| --- |\n" * 50)
    assert not pairs.says_nothing(skeleton + " Revenue rose.") and not pairs.says_nothing("N/A\n" * 100 + "7") and not pairs.says_nothing("<" * 100_000 + "word")


def test_a_hash_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    df = spark.range(3000).selectExpr("cast(id % 2500 as string) as a", "cast(null as string) as b")
    one, two = pairs.hash_sample(df.repartition(7), ["a", "b"], 100), pairs.hash_sample(df.coalesce(1), ["a", "b"], 100)
    assert one == two and len(one) == 100 and len(pairs.hash_sample(df, ["a", "b"], 5000)) == 3000
