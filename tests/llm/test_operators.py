"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm import exact_dedup, fingerprint, language_id, line_dedup, mixing, near_dedup, packing, quality, token_count, url_filter
from panelforge.llm.common import ASCII_LOWER, fold
from tests_llm_helpers import brute_components, brute_copies

WORDS_49K, BYTES_50K = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def word_machine():
    return token_count.CompiledTokenizer(open(WORDS_49K, encoding="utf-8").read(), token_count.character_classes())


@pytest.fixture(scope="module")
def word_library():
    return library(WORDS_49K)


def area(good, bad):
    """Share of pairs that a score puts in the right order."""
    return ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()


# 1: token counts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("abcdeirstvm' <|>\n.é", max_size=60)), max_size=5))
def test_counts_equal_the_library(word_machine, word_library, texts):
    assert word_machine.count(texts).tolist() == [len(word_library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_hard_texts(word_machine, word_library):
    texts = ["'s 're don't ''s \"'s 'll'x 'rx", "a<|endoftext|>b <|startoftext|>", "İSTANBUL ΑΣ", "x\x1cy\x85z\xa0q", "½ ² Ⅳ 123 ٣", "한국어 가", "a" * 3000, "'" * 9, "e\u0301", "strength" * 400]
    assert word_machine.count(texts).tolist() == [len(word_library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("form", ["{}", "a{}b", "Î{}", "é{}1"])
def test_counts_of_every_character(word_machine, word_library, form):
    """All code points in blocks of texts; a block's counts are compared one by one only where its sum differs."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(form.format(chr(c)) for c in points[i : i + 512]) for i in range(0, len(points), 512)]
    want = [len(e.ids) for e in word_library.encode_batch(texts, add_special_tokens=False)]
    assert word_machine.count(texts).tolist() == want


def test_counts_do_not_depend_on_blocks(word_machine, monkeypatch, word_library):
    text = "the quick brown fox can't stop 42 " * 200
    want = len(word_library.encode(text, add_special_tokens=False).ids)
    for size in (200, 1000):
        monkeypatch.setattr(token_count, "BLOCK_CHARS", size)
        assert word_machine.count([text, "", text]).tolist() == [want, 0, want]


def test_prefix_scan_composes():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 5, (37, 5)).astype(np.uint8)
    scanned, state = token_count.Splitter.scan(maps), np.arange(5)
    for m, s in zip(maps, scanned, strict=True):
        state = m[state]
        assert (state == s).all()


def test_count_tokens_edges(edge_docs, no_docs, word_library):
    got = token_count.count_tokens(edge_docs, WORDS_49K, 2048).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(word_library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in edge_docs.collect())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert {r["doc_id"] for r in got if r["over_limit"]} == {7}
    assert token_count.count_tokens(no_docs, WORDS_49K).count() == 0


# 2: language


def test_language(corpus, edge_docs, no_docs):
    model = language_id.train(corpus, fold(F.col("doc_id")) != 2)
    out = language_id.identify(corpus, model).join(corpus.select("doc_id", "lang"), "doc_id").where(fold(F.col("doc_id")) == 2)
    right = out.where("lang = lang_pred").count() / out.count()
    assert right >= 0.98
    edges = {r["doc_id"]: r for r in language_id.identify(edge_docs, model).collect()}
    assert all(edges[i]["lang_pred"] == "und" and edges[i]["score"] == 0 for i in (3, 4, 5, 9))
    assert edges[6]["lang_pred"] in model.languages and all(0 <= r["score"] <= 1 for r in edges.values())
    empty = language_id.train(no_docs, F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(edge_docs, empty).collect()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0


def brute_grams(text, buckets):
    """Bucket counts of runs of one to three letters and blanks, one run at a time with whole numbers."""
    low = [32, *[ord(c) if c.isalpha() else 32 for c in text.lower()], 32]
    out, mask = Counter(), (1 << 32) - 1
    for order in (1, 2, 3):
        for i in range(len(low)):
            run = [*low[i : i + order], *[32] * (i + order - len(low))]
            if run[0] == 32 and (order == 1 or run[1] == 32):
                continue
            key = order * 0x9E3779B1 & mask
            for c, m in zip(run, (2654435761, 2246822519, 3266489917), strict=False):
                key = (key ^ c * m & mask) * 0x85EBCA6B & mask
                key ^= key >> 15
            out[key % buckets] += 1
    return out


def test_language_by_hand(spark, monkeypatch):
    texts = [("en", "The cat sat. On the mat!"), ("en", "A dog, the dog"), ("de", "Der Hund und die Katze ß"), ("fr", "Le été à l'école"), ("fr", "où est-ce"), ("de", "")]
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(texts)], "doc_id int, lang string, text string")
    model = language_id.train(df, F.lit(True), buckets=64)
    langs, counts = sorted({x for x, _ in texts}), {}
    for x in langs:
        counts[x] = sum((brute_grams(t, 64) for y, t in texts if y == x), Counter())
    unseen = ["the dog", "Katze und Hund", "école été", "x" * 50, "the Katze", "a  b \n c"]
    want = []
    for t in unseen:
        score = {}
        for x in langs:
            total = sum(counts[x].values()) + 0.5 * 64
            score[x] = np.log(sum(y == x for y, _ in texts) / len(texts)) + sum(n * np.log((counts[x][k] + 0.5) / total) for k, n in brute_grams(t, 64).items())
        best = max(score, key=score.get)
        want.append((best, 1 / sum(np.exp(v - score[best]) for v in score.values())))
    assert model.languages == langs
    for values in (1 << 22, 9):  # in one stretch and in many
        monkeypatch.setattr(language_id, "BLOCK_VALUES", values)
        got, share = model.score(unseen)
        assert got == [x for x, _ in want] and np.allclose(share, [p for _, p in want], rtol=1e-4)


def test_language_numerals(corpus, spark):
    """Numerals of any script are no letters."""
    model = language_id.train(corpus, F.lit(True))
    numerals = ["½", "²", "①", "Ⅳ", "٣", "൰", "１２", "🄁", "½ ② -- _ 7"]
    assert all(language_id.has_letter(t) == any(c.isalpha() for c in t) for t in [*numerals, "a½", "", "é", "文"])
    df = spark.createDataFrame(list(enumerate([*numerals, "½ the cat"])), "doc_id int, text string")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, model).collect()}
    assert all(out[i] == ("und", 0.0) for i in range(len(numerals))) and out[len(numerals)][0] != "und"


def test_language_many(spark):
    """Above the languages of one block, blocks give the answers of one model."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: letters[i % 26] + letters[i // 26 % 26] + letters[i // 676] + letters[i * 7 % 26]
    rows = [(i, f"l{i:04d}", f"{word(i)} {word(i)[::-1]}") for i in range(2001)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    model = language_id.train(df, F.lit(True), buckets=256)
    assert [len(b.languages) for b in model.blocks] == [2000, 1] and len(model.languages) == 2001
    one = language_id.LanguageModel([language_id.LanguageBlock(model.languages, np.hstack([b.log_probs for b in model.blocks]), np.concatenate([b.log_prior for b in model.blocks]))])
    some = df.where("doc_id % 40 = 0").unionByName(df.where("doc_id = 80")).unionByName(df.where("doc_id = 0").selectExpr("cast(null as int) as doc_id", "lang", "cast(null as string) as text"))
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    several, whole = (sorted(language_id.identify(some, m).collect(), key=key) for m in (model, one))
    assert [(r["doc_id"], r["lang_pred"]) for r in several] == [(r["doc_id"], r["lang_pred"]) for r in whole]
    assert np.allclose([r["score"] for r in several], [r["score"] for r in whole]) and several[-1]["lang_pred"] == "und"
    assert sum(r["lang_pred"] == f"l{r['doc_id']:04d}" for r in several[:-1]) > 40


# 3: exact copies


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_copies(edge_docs, block):
    rows = edge_docs.collect()
    groups = brute_copies(rows)
    got = exact_dedup.find_duplicates(edge_docs, block_chars=block).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max(known) if known else None)
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_copies_of_long_texts(spark, no_docs):
    base = "".join(chr(97 + i * i % 26) for i in range(999))
    texts = [base, base[:-1] + "!", base.upper(), base[:500] + "?" + base[501:], base + base, base * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.find_duplicates(df, block_chars=50).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 3, 4: 5, 5: 5}
    assert exact_dedup.find_duplicates(no_docs).count() == 0


def test_exact_deduplicate_keeps_one_row_each(edge_docs):
    out = exact_dedup.deduplicate(edge_docs)
    assert out.columns == edge_docs.columns
    left = out.collect()
    assert len(left) == len(brute_copies(edge_docs.collect())) and {1} .isdisjoint(r["doc_id"] for r in left) and sum(r["doc_id"] == 10 for r in left) == 1


def test_exact_deduplicate_of_repeated_rows(spark):
    """Ids that repeat with one text and with several, nulls among them: one row of each text stays, that of its largest id."""
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "A"), (2, "a"), (2, "c"), (None, "d"), (None, "D"), (None, "a"), (3, "e"), (3, "e"), (3, "e"), (4, None), (4, ""), (5, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, place int").repartition(4)
    left = exact_dedup.deduplicate(df).collect()
    assert Counter((r["doc_id"], (r["text"] or "").lower()) for r in left) == Counter({(1, "b"): 1, (2, "a"): 1, (2, "c"): 1, (None, "d"): 1, (3, "e"): 1, (5, ""): 1})
    assert all(rows[r["place"]] == (r["doc_id"], r["text"]) for r in left)


# 4: lines


def test_line_removal(spark, edge_docs, no_docs):
    rows = [(i, f"shared line\nown {i}\n\ntwice {i % 3}", f"s{i}") for i in range(8)] + [(20, None, "s1"), (21, "shared line", None), (22, "", "s0"), (20, "shared line\nshared line", "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("line", F.lit(1)).withColumn("site", F.lit(1))
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            sites[line].add(site)
    for least in (2, 3, 9):
        got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.remove_spread_lines(df, least).collect())
        want = Counter()
        for i, text, _ in rows:
            lines = [] if text is None else text.split("\n")
            kept = [x for x in lines if not x.strip() or len(sites[x]) < least]
            want[i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
        assert got == want
    assert line_dedup.remove_spread_lines(no_docs).count() == 0
    edges = line_dedup.remove_spread_lines(edge_docs, 2)
    assert edges.columns == [*edge_docs.columns, "n_lines", "n_removed"] and edges.count() == edge_docs.count()
    assert Counter((r["doc_id"], r["text"]) for r in edges.collect()) == Counter((r["doc_id"], r["text"]) for r in edge_docs.collect())
    with pytest.raises(ValueError):
        line_dedup.spread_lines(df, 1)


def test_many_removed_lines(spark):
    """A text of 100,000 spread lines, and rows of one id with different texts."""
    many = [f"line {i}" for i in range(100_000)]
    rows = [(1, "\n".join(many), "a"), (2, "\n".join(["own", *many[::-1]]), "b"), (3, "own text\nline 7", "c"), (3, "line 7\nother\n\nline 8", "d"), (3, "line 7\nother\n\nline 8", "d")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.remove_spread_lines(df, 2).collect())
    assert got == [(1, "", 100_000, 100_000), (2, "own", 100_001, 100_000), (3, "other\n", 4, 2), (3, "other\n", 4, 2), (3, "own text", 2, 1)]


def test_lines_near_a_high_threshold(spark):
    """Below the threshold by one, at it and far above it, and a line that most rows of few sites have."""
    lines = [(f"s{i}", f"at {k}") for k in (299, 300, 301, 400) for i in range(k)] + [(f"s{i % 7}", "hot") for i in range(5000)]
    df = spark.createDataFrame(lines, "source string, text string").repartition(5)
    want = {r["h"] for r in df.where("text in ('at 300', 'at 301', 'at 400')").select(F.xxhash64("text").alias("h")).collect()}
    assert {r["line"] for r in line_dedup.spread_lines(df, 300).collect()} == want


# 5: packing


def check_bins(rows, tokens, documents=None, attention=None):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= tokens and (not documents or len(items) <= documents) and (not attention or sum(n * n for _, n in items) <= attention)
    return len(bins)


def test_pieces_equal_the_library(corpus, edge_docs):
    lib = library(BYTES_50K)
    docs = corpus.select("doc_id", "text").unionByName(edge_docs.where("doc_id is not null and doc_id <> 10").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    pieces = packing.tokenized_pieces(docs, BYTES_50K, 100).collect()
    for doc, own in {d: sorted((r for r in pieces if r["doc_id"] == d), key=lambda r: r["piece"]) for d in texts}.items():
        ids = np.array([*lib.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist() and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 100 for r in own[1:]) and [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "a" + "\n" * 1_000_000, " \n\t" * 400_000 + "don't", " " * 5_000_000, "ab " * 300_000])
def test_ids_of_long_runs(text):
    own = packing.ByteTokenizer(open(BYTES_50K, encoding="utf-8").read())
    assert own.encode(text) == np.array(library(BYTES_50K).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("rule", packing.RULES)
@pytest.mark.parametrize(("documents", "attention"), [(None, None), (3, None), (None, 5000.0)])
def test_packing_under_every_constraint(spark, rule, documents, attention):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 500)
    df = spark.createDataFrame([(i % 400, i // 400, int(n), 0) for i, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint, ids_crc32 bigint")
    out = packing.pack(df, 100, documents, attention, (1.0, 0.3, 0.3), rule).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in out) == Counter((r["doc_id"], r["piece"], r["length"]) for r in df.collect())
    bins = check_bins(out, 100, documents, attention)
    if not documents and not attention:
        assert bins <= 1.03 * -(-int(lengths.sum()) // 100) + 1


def test_packing_edges(edge_docs, no_docs):
    out = packing.pack_documents(edge_docs, BYTES_50K).collect()
    check_bins(out, 2048)
    assert sum(r["doc_id"] == 10 for r in out) == 2 and sum(r["doc_id"] is None for r in out) == 1 and {r["length"] for r in out if r["doc_id"] in (3, 4)} == {1}
    assert packing.pack_documents(no_docs, BYTES_50K).count() == 0
    with pytest.raises(ValueError):
        packing.plan_bins({5: 1}, 4)


# 6: near copies


@pytest.mark.parametrize("words", [2, 5])
def test_near_copies_of_the_corpus(corpus, words):
    want, sizes = brute_components(corpus.collect(), words)
    got = near_dedup.near_components(corpus, words).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize(("members", "blocks"), [(16, 32), (6, 1)])
def test_near_copies_in_a_large_group(spark, monkeypatch, members, blocks):
    """Buckets cut into blocks, and with one block at most, dealt out anew."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(near_dedup, "MAX_BLOCKS", blocks)
    anew, dealt = [], near_dedup.dealt_anew
    monkeypatch.setattr(near_dedup, "dealt_anew", lambda *a: anew.append(1) or dealt(*a))
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = list(base)
        for k in rng.choice(60, rng.integers(0, 7), replace=False):
            words[k] = f"e{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, _ = brute_components(df.collect(), 2)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(df, 2).collect()} == want
    assert bool(anew) == (blocks == 1)


def test_near_copies_edges(edge_docs, no_docs):
    got = near_dedup.near_components(edge_docs, 2).collect()
    assert len(got) == edge_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[None]["kept"] and by[None]["component_id"] is None
    assert all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (3, 4, 5)) and by[6]["n_shingles"] == 1 and by[7]["n_shingles"] == 1
    assert near_dedup.near_components(no_docs).count() == 0
    left = near_dedup.deduplicate(edge_docs, 2)
    assert left.columns == edge_docs.columns and left.where("doc_id = 2").count() == 0


@pytest.mark.parametrize("kind", ["string", "int"])
def test_near_copies_by_other_ids(spark, kind):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [("3", base), ("20", base + " more"), ("100", "nothing like it at all"), ("3", base), ("7", base.upper()), ("100", base + " words")]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(df, 5).collect()}
    # An id with two texts is one document: 100 is linked by its second text.
    assert {str(k): str(v) for k, v in got.items()} == dict.fromkeys(("3", "20", "7", "100"), "100" if kind == "string" else "3")
    with pytest.raises(TypeError):
        near_dedup.near_components(df.withColumn("doc_id", F.col("doc_id").cast("double")))


@pytest.mark.parametrize("most", [2, 60, 400])
def test_near_copies_of_heavy_texts(spark, monkeypatch, most):
    """Block pairs whose sets are too large to hold at once are cut, and no link is lost."""
    monkeypatch.setattr(near_dedup, "GROUP_SHINGLES", most)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 8)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(df, words=2).collect()}
    assert got == brute_components([{"doc_id": i, "text": t} for i, t in rows], 2)[0] and 1 < len(set(got.values())) < 60


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101)], "a bigint, b bigint").repartition(7)
    got = {r["id"]: r["component"] for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for size in (1, 5, 60, 800):
        a, b = np.unique(pool[:size]), np.unique(pool[size // 4 : size + size // 4])
        shared = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = near_dedup.signatures([a, b])
        assert abs((x == y).mean() - shared) < 0.17
        assert (near_dedup.signatures([a])[0] == x).all()


# 7: URLs


def brute_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].translate(ASCII_LOWER), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(t), t, v) for v, t in rules for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls(spark, no_docs):
    urls = [None, "", "no scheme", "http://A.com/x", "https://www.Example.com/en/1?x=1#t", "http://example.com/en/", "http://m.example.com/en/5", "https://notexample.com/en/1", "http://x.net/es/1", "http://net/fr/", "http://a.org?q=/en/", "x://y://z", "http://com", "http://com/", "http://b.net#/es/", "http://é.COM/É"] + [f"http://{'ab'[i % 2]}{i}.{['org', 'net', 'com'][i % 3]}/{['en', 'es', 'fr'][i // 3 % 3]}/{i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("mine")).withColumn("probability", F.lit(1))
    out = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert len(out) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = brute_rule(url, url_filter.RULES)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule), url
        assert out[i]["verdict"] == verdict if verdict else out[i]["verdict"] in ("allow", "block")
        assert 0 <= out[i]["block_score"] <= 1
    assert url_filter.judge(df.where("false")).count() == 0
    labelled = url_filter.judge(df.where("page_id >= 16"), rules=(), labels=F.when(F.col("url").contains("//b"), 1).otherwise(0))
    right = labelled.where((F.col("verdict") == "block") == F.col("url").contains("//b")).count()
    assert right > 100 and labelled.where("rule is not null").count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, rules=(("allow", "com/"),)).collect()} == {"allow"}


def test_near_signatures_rule_out_rarely():
    import math

    import numpy as np

    x = np.arange(near_dedup.PLACES)
    kept = [k for k in range(near_dedup.PLACES + 1) if near_dedup.close_enough(np.where(x < k, x, -1), x, 80)]
    missed = sum(math.comb(near_dedup.PLACES, k) * 0.8**k * 0.2 ** (near_dedup.PLACES - k) for k in range(kept[0]))
    assert missed < 5e-8 and kept[0] > 64


def test_url_sample_holds_a_url_once(spark, monkeypatch):
    urls = ["http://hot.org/x"] * 900 + [f"http://{'ab'[i % 2]}{i}.org/{i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(8)
    seen = []
    cut = url_filter.cut_lineage
    monkeypatch.setattr(url_filter, "cut_lineage", lambda x: seen.append(cut(x)) or seen[-1])
    blocked = F.when(F.col("url").contains("//b") | F.col("url").contains("hot"), 1).otherwise(0)
    assert url_filter.judge(df, rules=(), labels=blocked).count() == 1100
    weights = sorted(r["__weight"] for r in seen[-1].collect())
    assert len(weights) == 201 and weights[-1] == 900 and sum(weights) == 1100


def test_url_suffixes_of_other_folds(spark, monkeypatch):
    """Suffix statistics against a count by hand: a labelled URL must not see its own label."""
    urls = [f"http://h{i}.{['org', 'net', 'com'][i % 3]}/{i}" for i in range(90)] + ["http://h0.org/0"] * 30 + [f"http://u{i}.org/" for i in range(10)]
    y = [None if u.startswith("http://u") else float(i % 3 == 1 or i % 7 == 0) for i, u in enumerate(urls)]
    y = [1.0 if u == "http://h0.org/0" else v for u, v in zip(urls, y, strict=True)]
    df = spark.createDataFrame(list(zip(range(len(urls)), urls, y, strict=True)), "page_id bigint, url string, y double")
    folds = {r["url"]: r["f"] for r in df.select("url", F.floor(url_filter.unit_hash(F.col("url"), seed=71) * url_filter.FOLDS).alias("f")).collect()}
    seen = []
    cut = url_filter.cut_lineage
    monkeypatch.setattr(url_filter, "cut_lineage", lambda x: seen.append(cut(x)) or seen[-1])
    url_filter.judge(df, rules=(), labels=F.col("y"))
    got = Counter((*[round(x, 9) for x in r["__features"][-4:-2]], r["__y"]) for r in seen[-1].collect())
    known = [(u, v) for u, v in zip(urls, y, strict=True) if v is not None]
    base, want = sum(v for _, v in known) / len(known), Counter()
    for u, v in set(known):
        end = u.split("/")[2].split(".")[-1]
        other = [w for x, w in known if x.split("/")[2].endswith(end) and folds[x] != folds[u]]
        share = sum(x.split("/")[2].endswith(end) for x in urls) / len(urls)
        want[round(share, 9), round((sum(other) + 10 * base) / (len(other) + 10), 9), v] += 1
    assert got == want


def test_url_features_by_hand(spark):
    urls = [None, "", "https://a-b.c1.org/x/y//z?p=1&q=2#f-1", "x://h", "http://h/?", "ftp://1.2.3.4/a?b#c?d"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    u = F.col("url")
    rows = df.select("i", *[c.alias(k) for k, c in url_filter.lexical(u, *url_filter.host_and_path(u)).items()]).collect()
    for r in rows:
        url = urls[r["i"]] or ""
        host, path, *_ = brute_rule(url, ())
        query = url.partition("?")[2].split("#")[0] if "?" in url.split("#")[0] else ""
        want = {"length": len(url), "host_length": len(host), "path_length": len(path), "depth": sum(bool(x) for x in path.split("/")[1:]), "labels": host.count(".") + 1, "digits": sum(c.isdigit() for c in url) / max(len(url), 1),
                "parameters": query.count("&") + 1 if query else 0, "query_length": len(query), "fragment": float("#" in url), "secure": float(url.startswith("https")), "hyphens": host.count("-"), "host_digits": sum(c.isdigit() for c in host)}
        assert {k: r[k] for k in want} == pytest.approx(want), url


def test_many_url_rules(spark, monkeypatch):
    rules = (*url_filter.RULES, ("block", "b.org/x"), ("allow", "org/xyz"), ("block", "org/"), ("allow", "a.b.org/xy"))
    urls = [None, "http://b.org/xyz", "http://a.b.org/xyz/1", "http://xb.org/x", "http://www.example.com/en/", "http://q.net/es/a?b", "http://none.de/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")

    def found():
        return df.select(*url_filter.matching_rule(*url_filter.host_and_path(F.col("url")), rules)).collect()

    one = [tuple(r) for r in found()]
    monkeypatch.setattr(url_filter, "MAX_RULES", 3)
    assert [tuple(r) for r in found()] == one and [r[0] for r in one] == [brute_rule(u, rules)[2] for u in urls]


def test_urls_held_out(spark):
    """Area under the curve on labelled URLs whose labels the trees don't see, over a whole table."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    verdict = url_filter.matching_rule(*url_filter.host_and_path(F.col("url")))[1]
    pages = pages.withColumns({"y": F.when(verdict == "block", 1.0).when(verdict == "allow", 0.0), "held": url_filter.unit_hash(F.col("url"), seed=5) < 0.25})
    out = url_filter.judge(pages, rules=(), labels=F.when(~F.col("held"), F.col("y"))).where("held and y is not null").select("y", "block_score").toPandas()
    assert area(out.block_score[out.y == 1].to_numpy(), out.block_score[out.y == 0].to_numpy()) > 0.9


def test_url_entropy_of_the_whole_path(spark):
    import math
    from collections import Counter

    urls = ["http://a.org/" + "a" * 300 + "bcdé😀xyz" * 40, "http://a.org/aab", "no scheme", "http://a.org/" + "a" * 5000 + "0123456789", None]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    url = F.col("url")
    for r in df.select("i", "url", url_filter.lexical(url, *url_filter.host_and_path(url))["entropy"].alias("e")).collect():
        text = (r["url"] or "").partition("://")[2]
        want = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
        assert abs(r["e"] - want) < 1e-9, r["url"]


# 8: quality


def test_quality(spark, edge_docs, no_docs):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    model = quality.train(docs, labels, fold(F.col("doc_id")) != 2)
    out = quality.score(docs, model).join(labels, "doc_id").where(fold(F.col("doc_id")) == 2).where(F.length("text") > 0).toPandas()
    good, bad = (out[out.quality == k].quality_score.to_numpy() for k in (1, 0))
    assert area(good, bad) > 0.98 and ((out.quality_score >= 0.7) == (out.quality == 1)).mean() > 0.95
    difference = model.differences(out.text.tolist())
    assert area(difference[out.quality == 1], difference[out.quality == 0]) > 0.98  # the difference alone carries the score
    edges = quality.score(edge_docs, model).collect()
    assert len(edges) == edge_docs.count() and all(0 <= r["quality_score"] <= 1 for r in edges)
    assert {r["quality_score"] for r in edges if not r["text"]} == {model.prior}
    assert quality.score(no_docs, model).count() == 0
    one = quality.train(docs, labels.where("quality = 1"), F.lit(True))
    assert {r["quality_score"] for r in quality.score(edge_docs, one).collect()} == {1.0}


def test_quality_difference_by_hand(spark):
    """Chunk by chunk, with compressors made anew, against the model and the scored column."""
    import zstandard

    model = quality.CompressionModel(b"all the good words that are here " * 9, b"x | y | z | " * 20, np.array([30.0, -1.0]), 0.5)
    texts = ["a", "the good words that are here", "x | y | z | x", "Ünïcödé " * 400, "longer " * 30_000]

    def size(data, words):
        return len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words)).compress(data))

    want = []
    for t in map(str.encode, texts):
        good, bad = (sum(size(t[i : i + 256], words) for i in range(0, len(t), 256)) for words in (model.good, model.bad))
        want.append((bad - good) / len(t))
    assert np.allclose(model.differences(texts), want)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r["quality_score"] for r in quality.score(df, model).orderBy("doc_id").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(1 - 30 * np.array(want))))
    d, y = np.array([-0.2, -0.1, 0.0, 0.1, 0.2, 0.3]), np.array([0.0, 0, 1, 0, 1, 1])
    w, n = quality.fit_curve(d, y, np.ones(6)), 1e-5
    loss = lambda a, b: -np.log(np.where(y == 1, 1 / (1 + np.exp(-a * d - b)), 1 / (1 + np.exp(a * d + b)))).sum()
    assert w[0] > 0 and abs(loss(w[0] + n, w[1]) - loss(w[0] - n, w[1])) < 1e-5


def test_pieces_spread_over_a_text(spark):
    text = "".join(chr(97 + i // 512 % 26) for i in range(512 * 40 + 100))
    df = spark.createDataFrame([(text,), ("ab",), ("c" * 513,)], "t string").select(quality.pieces_of(F.col("t")).alias("p"))
    long, short, two = (r["p"] for r in df.collect())
    assert short == ["ab"] and two == ["c" * 512, "c"]
    assert long == [text[512 * (k * 41 // 8) :][:512] for k in range(8)]


# 9: mixing


def brute_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= set(over)
    return target


def test_mix_of_rows_that_share_an_id(spark):
    """Rows of one id stand in a fixed order by their texts, and each keeps its own passes."""
    rows = [(i // 4, " ".join(f"w{i}" for _ in range(1 + i % 7)), "ab"[i % 2]) for i in range(200)] + [(None, f"no id {i}", "b") for i in range(30)] + [(7, "twice the same row", "a")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["mark"], r["passes"]) for r in mixing.mix(df).collect())
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["mark"], r["passes"]) for r in mixing.mix(df.repartition(7, "text")).collect())
    assert len({(a, b, c) for a, b, c, _ in got}) == len(got) - 1
    taken = Counter((r["doc_id"], r["text"]) for r in mixing.take(df).collect())
    marks = {r["m"]: r["text"] for r in df.select("text", mixing.text_mark(F.col("text")).alias("m")).collect()}
    want = Counter()
    for none, i, mark, passes in got:
        want[None if none else i, marks[mark]] += passes
    assert taken == +want


def test_water_filling_of_many_sources(spark):
    sizes = [(f"s{i:04d}" if i else None, (i * 7919) % 1000 + (i % 3 == 0) * 10**6) for i in range(700)]
    df = spark.createDataFrame(sizes, "source string, source_size bigint").repartition(6)
    got = {r["source"]: r["target"] for r in mixing.water_fill(df).collect()}
    want = brute_targets(dict(sizes), mixing.WEIGHTS, 3)
    assert all(abs(got[k] - want[k]) <= 1e-6 * max(1, want[k]) for k in want) and len(got) == len(want)


def test_water_filling(spark):
    for sizes in ({"a": 10, "b": 500, "c": 40, None: 7, "B": 90}, {"a": 5}, {"a": 0, "b": 10}, {"a": 10, "b": 10, "c": 1000, "d": 20}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.water_fill(df).collect()}
        want = brute_targets(sizes, mixing.WEIGHTS, 3)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (got, want)


def test_mix(corpus, edge_docs, no_docs):
    got = mixing.mix(corpus).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(corpus.repartition(5)).collect()))
    texts = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in corpus.collect()}
    assert {r["doc_id"]: r["size"] for r in got} == texts
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert abs(sum(target.values()) - sum(texts.values())) < 1e-6 * sum(texts.values())
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    assert mixing.take(corpus).count() == sum(r["passes"] for r in got)
    edges = mixing.mix(edge_docs).collect()
    assert len(edges) == edge_docs.count() and mixing.mix(no_docs).count() == 0 and mixing.take(edge_docs).columns == edge_docs.columns


# 10: fingerprints


def brute_digest(text):
    """Length code and quartile codes, counted one triplet at a time with whole numbers."""
    data, low = text.encode(), (1 << 32) - 1
    counts = [0] * 512
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        key = (a * 0x9E3779B1 & low) ^ (b * 0x85EBCA6B & low) ^ (c * 0xC2B2AE35 & low)
        counts[((key ^ key >> 15) * 0x27D4EB2F & low) >> 23] += 1
    quartiles = [sorted(counts)[k] for k in (128, 256, 384)]
    codes = [sum(n > q for q in quartiles) for n in counts] if len(data) > 2 else [0] * 512
    return min(255, round(4 * np.log2(len(data) + 1))), codes


def brute_likeness(x, y):
    (m, a), (n, b) = brute_digest(x), brute_digest(y)
    cost = (0, 1, 2.5, 6)
    apart = sum(cost[abs(i - j)] for i, j in zip(a, b, strict=True)) + min(4 * max(abs(m - n) - 1, 0), 200)
    most = 512 * sum(cost[abs(i - j)] for i in range(4) for j in range(4)) / 16
    return 1 - min(apart, most) / most


@pytest.mark.parametrize("cuts", [4, 1024])
def test_fingerprints_of_edits(corpus, monkeypatch, cuts):
    monkeypatch.setattr(fingerprint, "CUTS", cuts)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in corpus.collect()))
    got = {r["doc_id"]: r for r in fingerprint.edited(fingerprint.with_next(corpus, rows_per_range=17)).collect()}
    assert len(got) == len(rows)
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edit = text[: len(text) - cut] + following[:cut]
        assert got[doc]["edited"] == edit and got[doc]["fingerprint"] == fingerprint.digest(text.encode()) and got[doc]["edited_fingerprint"] == fingerprint.digest(edit.encode())
        assert got[doc]["next_fingerprint"] == fingerprint.digest(following.encode())
        if k % 20 == 0:
            length, codes = brute_digest(text)
            packed = sum(c << 2 * i for i, c in enumerate(reversed(codes)))
            assert got[doc]["fingerprint"] == f"{length:02x}{packed:0256x}"
            assert abs(got[doc]["near_edited"] - brute_likeness(text, edit)) < 1e-9 and abs(got[doc]["near_next"] - brute_likeness(text, following)) < 1e-9
    nearer = np.mean([r["near_edited"] > r["near_next"] for r in got.values()])
    assert nearer > 0.97


def test_fingerprint_edges(spark, edge_docs, no_docs):
    for ranges in (1, 2, 4000):
        out = fingerprint.edited(fingerprint.with_next(edge_docs, rows_per_range=ranges))
        rows = out.collect()
        assert len(rows) == edge_docs.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint.with_next(no_docs).count() == 0
    with pytest.raises(TypeError):
        fingerprint.with_next(edge_docs.withColumn("doc_id", F.lit("a")))
    one = fingerprint.edited(fingerprint.with_next(spark.createDataFrame([(5, "abcdefgh")], "doc_id bigint, text string"))).first()
    assert one["edited"] == "abcdefab" and one["near_next"] == 1
    a, b = fingerprint.digest(b"abc" * 50), fingerprint.digest(b"xyz" * 50)
    assert fingerprint.likeness([a, a], [a, b])[0] == 1 and fingerprint.likeness([a], [b])[0] == fingerprint.likeness([b], [a])[0] < 1
    assert {r["fingerprint"] for r in fingerprint.fingerprints(edge_docs).where("doc_id = 10").collect()} == {fingerprint.digest(b"a row that repeats as it is, twice over")}


# All


def test_very_long_text(spark, corpus):
    """A text of 3 million characters beside short ones goes through every operator whole."""
    long = "word " * 300_000 + "\n" * 200_000 + "tail " * 260_000
    df = spark.createDataFrame([(1, long, "en", "a"), (2, "word tail", "en", "b"), (3, long.upper(), "en", "c")], "doc_id bigint, text string, lang string, source string").repartition(2)
    by = lambda out: {r["doc_id"]: r for r in out.collect()}
    assert by(token_count.count_tokens(df, WORDS_49K))[1]["n_tokens"] == 560_000
    model = language_id.train(corpus, F.lit(True))
    assert by(language_id.identify(df, model))[1]["lang_pred"] in model.languages
    copies = by(exact_dedup.find_duplicates(df))
    assert copies[1]["keep_id"] == 3 and copies[1]["group_size"] == 2
    assert by(line_dedup.remove_spread_lines(df))[1]["n_lines"] == long.count("\n") + 1
    assert by(mixing.mix(df))[1]["size"] == 560_000
    assert by(near_dedup.near_components(df))[3]["component_id"] == 1
    marks = fingerprint.edited(fingerprint.with_next(df)).collect()
    assert {r["doc_id"]: r["n_chars"] for r in marks}[1] == len(long)
    fitted = quality.CompressionModel(b"word tail " * 90, b"x | y " * 90, np.array([30.0, 0.0]), 0.5)
    assert by(quality.score(df, fitted))[1]["quality_score"] > 0.5
    pieces = packing.tokenized_pieces(df.where("doc_id = 1"), BYTES_50K).collect()
    assert sum(r["length"] for r in pieces) == len(library(BYTES_50K).encode(long, add_special_tokens=False).ids) + 1
