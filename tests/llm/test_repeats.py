"""Operators 11 to 13 against brute force, and on the cases that every operator must handle."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from panelforge.llm import conversation_repair, periodic_runs, queries, substring_dedup

DATA = "/root/testdata/sf0.001"


# Operator 11


def brute_repeats(rows, size):
    """Per row: words, removed words, kept text; None ids come last."""
    split = [(float("inf") if i is None else i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            least[x] = min(least.get(x, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def found_repeats(df, size):
    out = substring_dedup.remove_repeats(df, size).select("doc_id", "n_words", "n_removed", "text", "removed_spans").collect()
    for r in out:
        assert sum(s["length"] for s in r["removed_spans"]) == r["n_removed"]
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], r["n_removed"], r["text"] or "") for r in out)


def expected_repeats(rows, size):
    return sorted(((i is None, i or 0), *b) for (i, _), b in zip(rows, brute_repeats(rows, size), strict=True))


@pytest.mark.parametrize("size", [1, 3, 5, 13])
def test_repeats_brute_force(spark, size):
    rng = random.Random(size)
    passages = [[rng.choice("abcdefg") for _ in range(rng.randrange(5, 30))] for _ in range(6)]
    rows = []
    for i in range(150):
        words = [rng.choice("abcdefghijklmnop" if size > 3 else "abcdefghijklmnopqrstuvwxyzABCDEFGH") for _ in range(rng.randrange(40))]
        if rng.random() < 0.6:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((rng.choice([i, i, i, 3, None]), rng.choice([" ", "\n", "  "]).join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found_repeats(df, size) == expected_repeats(rows, size)


def test_repeats_frequent_prefixes_change_nothing(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(60))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = expected_repeats(rows, 13)
    assert found_repeats(df, 13) == want
    monkeypatch.setattr(substring_dedup, "FREQUENT", 2)
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 100)
    monkeypatch.setattr(substring_dedup, "GROUP_WINDOWS", 10)
    assert len(substring_dedup.frequent_prefixes(df, 13, 80, "text", "doc_id")) > 5
    assert found_repeats(df, 13) == want


def test_repeats_large_group_of_copies(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text) for i in range(3000)] + [(9000, "before it " + text + " and after")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    out = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df, 13).collect()}
    assert out[0]["n_removed"] == 0 and all(out[i]["n_removed"] == 40 and out[i]["text"] == "" for i in range(1, 3000))
    assert out[9000]["text"] == "before it and after" and [tuple(s) for s in out[9000]["removed_spans"]] == [(2, 40)]


def test_repeats_edges(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    for size in (2, 13):
        assert found_repeats(edge_docs, size) == expected_repeats(rows, size)
    out = substring_dedup.remove_repeats(edge_docs, 2)
    assert set(edge_docs.columns) < set(out.columns) and out.where("text is null").count() == 1
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    again = substring_dedup.remove_repeats(out.select("doc_id", "text", "n_words", "n_removed"), 2)
    assert again.columns == ["doc_id", "text", "n_words", "n_removed", "removed_spans"]
    with pytest.raises(TypeError):
        substring_dedup.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_repeats_long_text(spark):
    words = [f"w{i % 70_000}" for i in range(300_000)]
    df = spark.createDataFrame([(1, " ".join(words[:100_000])), (2, " ".join(words))], "doc_id bigint, text string")
    out = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df).select("doc_id", "n_removed").collect()}
    assert out == {1: 0, 2: 300_000}


# Operator 12


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            smaller = any(all(w[x] == w[x + r] for x in range(start, start + length - r)) for r in range(1, q))
            if length >= max(24, 3 * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def repeating(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(150))]
    if kind == 1:
        block = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        return [rng.randrange(3) for _ in range(rng.randrange(20))] + block * rng.randrange(1, 8) + [rng.randrange(3) for _ in range(20)]
    if kind == 2:  # a period in which every long gram occurs twice
        parts = {"A": [1] * rng.randrange(3, 20), "B": [2] * rng.randrange(3, 20)}
        return [x for c in "AAABBBAB" for x in parts[c]] * rng.randrange(2, 5) + [3] * rng.randrange(60)
    block = [rng.randrange(4) for _ in range(rng.randrange(1, 5))]
    return ((block * rng.randrange(4, 12) + [rng.randrange(4) for _ in range(rng.randrange(9))]) * rng.randrange(2, 5))[:400]


def test_runs_brute_force():
    rng = random.Random(12)
    texts = [repeating(rng) for _ in range(300)]
    got = periodic_runs.runs_of(np.array([x for w in texts for x in w]), [len(w) for w in texts])
    assert got == [brute_runs(w) for w in texts] and sum(map(len, got)) > 300


def test_runs_long_texts():
    assert periodic_runs.runs_of(np.zeros(2_000_000, np.int64), [2_000_000]) == [[(0, 2_000_000, 1)]]
    block = np.random.default_rng(1).integers(0, 9999, 100_000)
    assert periodic_runs.runs_of(np.tile(block, 4), [400_000]) == [[(0, 400_000, 100_000)]]


def expected_periodic(doc_id, text):
    w = (text or "").encode().split()
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query(spark, tmp_path, corpus):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{x}" for x in repeating(rng))) for i in range(200)]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in corpus.collect() if r["text"] is None or len(r["text"]) < 6000]
    rows += [(5000, None), (5001, ""), (5002, " \t "), (None, "one two " * 30), (None, None), (5003, "x"), (5003, "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [k for c, k in out.dtypes[1:6]] == ["bigint"] * 5
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted([(i, *expected_periodic(i, t)) for i, t in rows], key=key)


def test_runs_edges(edge_docs, no_docs):
    out = periodic_runs.collapse_runs(edge_docs)
    assert set(edge_docs.columns) < set(out.columns) and out.count() == edge_docs.count()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [tuple(x) for x in rows[7]["runs"]] == [(0, 9000, 1)] and rows[7]["collapsed"] == "word" and rows[3]["collapsed"] == ""
    assert periodic_runs.collapse_runs(no_docs).count() == 0 and periodic_runs.with_planted_runs(no_docs).columns == no_docs.columns
    again = periodic_runs.collapse_runs(out.select("doc_id", "text", "runs", "n_words"))
    assert again.columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and again.where("n_words = 9000").count() == 1


# Operator 13


MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def all_edits(turns, faults):
    """Least (cost, audit) over all sequences of edits with at most two insertions in a row."""
    best = (10**9, "")

    def walk(i, state, cost, audit, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(turns) and state in (0, 3):
            best = min(best, (cost, audit))
        if inserted < 2:
            for x in "ua":
                if (state, x) in MOVES:
                    walk(i, MOVES[state, x], cost + 3, audit + "I", inserted + 1)
        if i == len(turns):
            return
        walk(i + 1, state, cost + 4, audit + "D", 0)
        if faults[i] not in ("b", "d"):
            more = 3 if faults[i] == "t" else 0
            for x, c, e in ((turns[i][1][:1], 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                if (state, x) in MOVES:
                    walk(i + 1, MOVES[state, x], cost + c + more, audit + e, 0)

    walk(0, 0, 0, "", 0)
    return best


def brute_repair(rows):
    """rows (turn, role, text) of a conversation, in order, to its expected columns."""
    faults, seen = [], set()
    for _, r, x in rows:
        w = x.encode().split()
        faults.append("b" if not w else "d" if (r, x) in seen else "t" if w[-1][-1:] not in b".!?" else "")
        seen.add((r, x))
    cost, audit = all_edits(rows, faults)
    state, i, lines = 0, 0, []
    for e in audit:
        if e == "D":
            i += 1
            continue
        role, text = ("assistant" if state == 2 else "user", "") if e == "I" else rows[i][1:]
        role = ("assistant" if state == 2 else "user") if e == "R" else role
        i += e != "I"
        state = MOVES[state, role[:1]]
        lines.append(f"{role}:{text}")
    known = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged_rows(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def expected_repairs(rows, damage=True):
    held = defaultdict(list)
    for c, t, r, x in damaged_rows(rows) if damage else rows:
        held[c].append((t, r, x))
    order = lambda r: (r[0] is not None, r[0] or 0)  # noqa: E731  turns are told apart by their numbers here
    return {c: brute_repair(sorted(held[c], key=order)) for c in {r[0] for r in rows}}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TEXTS = ["Hello there.", "What?", "cut off", "", "  ", None, "No!  ", "1 2 3", "done.\n", "Hello there."]


def random_conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 6)):
            if rng.random() < 0.9:
                rows.append((c, None if t == 0 and rng.random() < 0.2 else t * rng.choice([1, 1, 1, 2]) + (t > 0) * 10 * t, rng.choice(["user", "assistant", "system", "tool", "u", "", None, "user", "assistant"]), rng.choice(TEXTS)))
    return rows


@pytest.mark.parametrize("chunk", [2, 4096])
def test_repair_brute_force(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(conversation_repair, "CHUNK", chunk)
    rows = random_conversations(random.Random(chunk), 120) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (-5, None, None, None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op13_conversation_repair(spark, str(tmp_path))
    assert out.columns == ["conv_id", *COLUMNS] and [k for c, k in out.dtypes[1:7]] == ["bigint"] * 6
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    assert got == expected_repairs(rows)


def test_repair_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_conversation_repair(spark, DATA).collect()}
    assert got == expected_repairs(rows)


def test_repair_edges(spark):
    schema = "conv_id string, turn int, role string, text string, conv string, dig string, symbol string"
    rows = [("a", 1, "user", "Hi."), ("a", 1, "user", "Hi."), ("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), ("b", None, None, None), ("b", None, None, None), (None, 1, "system", "Go.")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversation_repair.repair(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got["a"] == (0, 0, 2, 0, 2, 8, "KDDK", sha("user:Hi.\nassistant:Yes."))
    assert got["b"] == (0, 2, 0, 0, 1, 8, "DD", sha(""))
    assert got[None] == (0, 0, 0, 0, 0, 4, "D", sha(""))
    none = spark.createDataFrame([], schema)
    assert conversation_repair.repair(none).count() == 0
    everyone = conversation_repair.repair(none, everyone=df).collect()
    assert {r["conv_id"] for r in everyone} == {"a", "b", None} and all(r["audit"] == "" and r["repaired_sha256"] == sha("") and r["cost"] == 0 for r in everyone)


def test_repair_long_conversation(spark):
    """One conversation holds nearly all turns; its chunks are of several partitions."""
    n = 20_000
    rows = spark.range(n).selectExpr("1 as conv_id", "id as turn", "case when id % 2 = 0 then 'user' else 'assistant' end as role", "concat('turn ', id, '.') as text")
    other = spark.createDataFrame([(2, 0, "user", "Hi."), (2, 5, "assistant", "so")], "conv_id int, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in conversation_repair.repair(rows.unionByName(other)).collect()}
    text = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:turn {i}." for i in range(n))
    assert got[1]["audit"] == "K" * n and got[1]["cost"] == 0 and got[1]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert (got[2]["gaps"], got[2]["audit"], got[2]["cost"]) == (4, "KK", 3)


def test_repair_grammar(spark):
    """Rules spell the chunks, and their matrices are the products of their symbols' ones."""
    chunks = spark.createDataFrame([("uauauaua",), ("uauauUxa",), ("suauaua",), ("x",), ("uauauaua",)], "symbols string")
    distinct, rules = conversation_repair.grammar(chunks, lambda df: df)
    names = {chr(conversation_repair.FIRST_RULE + i): pair for i, pair in enumerate(rules)}
    spell = lambda s: "".join(spell(a) + spell(b) for a, b in [names[s]]) if s in names else s
    rows = distinct.collect()
    assert rules and len(rows) == 4
    for r in rows:
        assert "".join(map(spell, r["seq"])) == r["symbols"]
    table = conversation_repair.matrices(rules)
    for s in names:
        whole = None
        for x in spell(s):
            whole = conversation_repair.symbol_matrix(x) if whole is None else conversation_repair.product(whole, conversation_repair.symbol_matrix(x))
        flat = lambda m: {k: (c, conversation_repair.spelled(r)) for k, (c, r) in m.items()}
        assert flat(table[s]) == flat(whole)


def test_damage(spark):
    rows = random_conversations(random.Random(5), 60)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, conversation_repair.damaged(df).collect()), key=key) == sorted(damaged_rows(rows), key=key)
    assert conversation_repair.damaged(df.where("false")).count() == 0
