"""Cheapest repair of conversations by dynamic programming over a grammar of their turns.

Each turn is a symbol: the initial of its role, in capitals if its text is cut off, or x if it has to go. Symbol strings
are cut into chunks of bounded length, and equal chunks of all conversations are one.

1. Re-Pair: the most frequent neighbouring symbols become a rule, round after round, over all distinct chunks at once.
2. A rule's transfer matrix holds, from each state of the role pattern to each, the least cost and the edits that reach
   it, as a rope of the ropes of its two halves. Rules are evaluated bottom-up in min-plus algebra, once for all
   conversations; so is each distinct chunk, as a product of the matrices of its symbols.
3. A conversation's cost and edits are the product over its chunks, in order, from the start to an accepting state.

Of edits with equal costs the ASCII-least stay. That carries over to products: edits between the same states over the
same turns all end with a letter for the last turn, so none is the beginning of another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
RETAG, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Turns of a chunk; rounds of Re-Pair and rules of each: at most 256 rules, whatever the corpus.
CHUNK, ROUNDS, RULES_A_ROUND = 4096, 8, 32
FIRST_RULE = 0xE000
#: States of the role pattern (s?(ua)+)?: nothing yet, after s, after u, after a; the first and last accept.
STATES, ACCEPTING = range(4), (0, 3)
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Symbol of a turn that must be deleted.
GONE = "x"


def spelled(rope: str | tuple) -> str:
    """The letters of a rope: a text, or a pair of ropes."""
    if isinstance(rope, str):
        return rope
    out, left = [], [rope]
    while left:
        top = left.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            left += (top[1], top[0])
    return "".join(out)


def better(new: tuple, old: tuple | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and spelled(new[1]) < spelled(old[1])


def product(x: dict, y: dict) -> dict:
    """Min-plus product of matrices {(from, to): (cost, rope)}; absent: impossible."""
    out: dict = {}
    for (p, q), (c1, r1) in x.items():
        for t in STATES:
            if (q, t) in y:
                c2, r2 = y[q, t]
                new = (c1 + c2, (r1, r2) if r1 and r2 else r1 or r2)
                if better(new, out.get((p, t))):
                    out[p, t] = new
    return out


def insertions() -> dict:
    """Cheapest insertions of user and assistant turns between states."""
    out: dict = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, q), (cost, rope) in list(out.items()):
            for letter in "ua":
                to = MOVES[letter].get(q)
                if to is not None and better(new := (cost + INSERT, rope + "I"), out.get((p, to))):
                    out[p, to] = new
    return out


def symbol_matrix(symbol: str) -> dict:
    """Insertions before a turn, then its own edit."""
    own: dict = {(p, p): (DELETE, "D") for p in STATES}
    if symbol != GONE:
        more = CUT_OFF if symbol.isupper() else 0
        for letter, cost, edit in ((symbol.lower(), 0, "K"), ("u", RETAG, "R"), ("a", RETAG, "R")):
            for p, q in MOVES.get(letter, {}).items():
                if better(new := (cost + more, edit), own.get((p, q))):
                    own[p, q] = new
    return product(insertions(), own)


def symbol_of(initial: Column, gone: Column, cut_off: Column) -> Column:
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(gone, GONE).when(cut_off, F.upper(known)).otherwise(known)


def fields(like: DataFrame, **kinds: str) -> T.StructType:
    """A schema of conv, as in like, and named columns of simple types."""
    known = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType()}
    return T.StructType([T.StructField("conv", like.schema["conv"].dataType), *[T.StructField(c, known[k]) for c, k in kinds.items()]])


def grammar(chunks: DataFrame, keep, rounds: int = ROUNDS, rules_a_round: int = RULES_A_ROUND) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Distinct ``symbols`` with ``seq``, the same in symbols and rules; and the rules, each a pair of earlier symbols.

    Pairs of a round share no symbol, so that one does not undo another's count.
    """
    work = keep(chunks.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")).withColumn("seq", F.col("symbols")))
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        pairs = F.transform(F.sequence(F.lit(1), F.length("seq") - 1), lambda i: F.substring(F.col("seq"), i, F.lit(2)))
        counts = work.where(F.length("seq") > 1).select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        used: set[str] = set()
        fresh = []
        for (pair,) in counts.orderBy(F.desc("n"), "pair").select("pair").limit(8 * rules_a_round).collect():  # a bounded number of pairs
            if len(fresh) < rules_a_round and not used & set(pair):
                used |= set(pair)
                fresh.append((pair[0], pair[1]))
        if not fresh:
            break
        seq = F.col("seq")
        for a, b in fresh:
            seq = F.replace(seq, F.lit(a + b), F.lit(chr(FIRST_RULE + len(rules))))
            rules.append((a, b))
        work = keep(work.withColumn("seq", seq))
    return work.select("symbols", "seq"), rules


def matrices(rules: list[tuple[str, str]]) -> dict[str, dict]:
    """The matrix of each symbol and rule, bottom-up."""
    out = {s: symbol_matrix(s) for s in "suaoSUAO" + GONE}
    for i, (a, b) in enumerate(rules):
        out[chr(FIRST_RULE + i)] = product(out[a], out[b])
    return out


def chunk_matrices(distinct: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """symbols, and the entries (p, q, cost, edits) of the chunk's matrix."""
    table = matrices(rules)
    entry = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seq in batch.column(1).to_pylist():
                whole = table[seq[0]]
                for s in seq[1:]:
                    whole = product(whole, table[s])
                rows.append([{"p": p, "q": q, "cost": c, "edits": spelled(r)} for (p, q), (c, r) in whole.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, entry)], names=["symbols", "matrix"])

    return distinct.mapInArrow(run, "symbols string, matrix array<struct<p:int,q:int,cost:bigint,edits:string>>")


def chunks_of(turns: DataFrame) -> DataFrame:
    """Chunks of the turns' symbols: conv, part and chunk (their order), symbols, illegal pairs inside, outer initials.

    Spark deals the turns out by range of conversation and turn, so a long conversation is many tasks' work.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "dig"]
    sorted_turns = turns.select("conv", "turn", "role", "dig", "symbol").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = sorted_turns.select("conv", F.substring("role", 1, 1).alias("initial"), "symbol", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, part, number, conv, symbols, initials = None, None, 0, None, [], []

        def chunk() -> pa.RecordBatch:
            pairs = zip(initials, initials[1:], strict=False)
            values = [conv, part, number, "".join(symbols), sum(a + b not in ("su", "ua", "au") for a, b in pairs), initials[0], initials[-1]]
            kinds = [kind, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["conv", "part", "chunk", "symbols", "illegal", "first", "last"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, i, s, at in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if symbols and (c != conv or len(symbols) == CHUNK):
                    yield chunk()
                    symbols, initials, number = [], [], number + 1
                conv, part = c, at
                symbols.append(s)
                initials.append(i)
        if symbols:
            yield chunk()

    return rows.mapInArrow(run, fields(turns, part="int", chunk="long", symbols="string", illegal="long", first="string", last="string"))


def solved(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """conv, illegal, cost, audit: the product of each conversation's chunks, streamed in order."""
    rows = chunks.join(found, "symbols").select("conv", "part", "chunk", "illegal", "first", "last", "matrix")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "part", "chunk")
    ends = insertions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, conv, state, illegal, last = None, [], None, None, 0, ""

        def result() -> tuple:
            final = product(state, ends)
            best = None
            for q in ACCEPTING:
                if (0, q) in final and better(final[0, q], best):
                    best = final[0, q]
            return conv, illegal, best[0], spelled(best[1])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names=["conv", "illegal", "cost", "audit"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, i, a, z, m in zip(*[batch.column(k).to_pylist() for k in ("conv", "illegal", "first", "last", "matrix")], strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append(result())
                    conv, state, illegal, last = c, {(0, 0): (0, "")}, 0, None
                illegal += i + (last is not None and last + a not in ("su", "ua", "au"))
                last = z
                state = {k: (cost, spelled(rope)) for k, (cost, rope) in product(state, {(e["p"], e["q"]): (e["cost"], e["edits"]) for e in m}).items()}
            if out:
                yield batch_of(out)
                out = []
        if state is not None:
            yield batch_of([result()])

    return rows.mapInArrow(run, fields(chunks, illegal="long", cost="long", audit="string"))


def applied(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order, in one partition: conv, turn, role, text (of the audit: its edits)."""
    heads = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("dig"), F.col("audit").alias("text"))
    rows = heads.unionByName(turns.select("conv", F.lit(1).alias("kind"), "turn", "role", "dig", "text"))
    return rows.repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "dig").select("conv", "kind", "turn", "role", "text")


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, edit, turn, role, text) of repaired turns, and (conv, None, None, None, None) where a conversation begins."""
    edits, at, last = "", 0, ""
    conv = None

    def inserted() -> Iterator[tuple]:
        nonlocal at, last
        while at < len(edits) and edits[at] == "I":
            last, at = "a" if last == "u" else "u", at + 1
            yield conv, "I", None, "user" if last == "u" else "assistant", ""

    for batch in batches:
        for c, kind, turn, role, text in zip(*[col.to_pylist() for col in batch.columns], strict=True):
            if kind == 0:
                yield from inserted()
                conv, edits, at, last = c, text, 0, ""
                yield conv, None, None, None, None
                continue
            yield from inserted()
            edit, at = edits[at], at + 1
            if edit == "K":
                last = role[:1]
                yield conv, "K", turn, role, text
            elif edit == "R":
                last = "a" if last == "u" else "u"
                yield conv, "R", turn, "user" if last == "u" else "assistant", text
    yield from inserted()


def prepared(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, keep) -> DataFrame:
    """conv, turn, role, text, dig, and the faults: blank, duplicate, truncated, symbol."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    t = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    t = t.withColumn("dig", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    # Where role and text repeat, the first turn keeps one. Rows that agree in all are told apart by their place.
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = t.groupBy("conv", "dig").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first")).where("rows > 1")
    again = keep(again.select(F.col("conv").alias("r_conv"), F.col("dig").alias("r_dig"), F.col("first.turn").alias("first_turn")))
    t = t.join(again, t["conv"].eqNullSafe(again["r_conv"]) & (t["dig"] == again["r_dig"]), "left")
    later = F.col("r_dig").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    # Candidates for the first: usually one row, so this window sees few; rows that are equal in all are the rest.
    end = F.rtrim("text", F.lit(BLANKS))
    t = t.select("conv", "turn", "role", "text", "dig", (end == "").alias("blank"), later.alias("later"), (F.col("r_dig").isNotNull() & ~later).alias("one_of"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("open"))
    same = t.where("one_of and not blank").withColumn("nth", F.expr("row_number() over (partition by conv, turn, dig order by role)"))
    t = t.where("not one_of or blank").withColumn("nth", F.lit(1)).unionByName(same)
    t = t.withColumn("duplicate", ~F.col("blank") & (F.col("later") | (F.col("nth") > 1)))
    t = t.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
    # A duplicate stands after the turn that it repeats, also where the two agree in all.
    symbol = symbol_of(F.substring("role", 1, 1), F.col("blank") | F.col("duplicate"), F.col("truncated"))
    return keep(t.select("conv", "turn", "role", "text", F.concat("dig", F.when(F.col("nth") > 1, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))).alias("dig"), "blank", "duplicate", "truncated", symbol.alias("symbol")))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", everyone: DataFrame | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns stand in the order of turn_col (nulls first; ties by role, then by a digest of role and text). A turn's first
    fault counts: blank (no word), duplicate (role and text seen earlier), truncated (does not end in ``.!?``). gaps are
    missing numbers between the least and the greatest turn, illegal are neighbours whose role initials are not su, ua or
    au. audit is the cheapest sequence of edits (Keep, Rerole, Delete, Insert) that gives roles ``(s?(ua)+)?``, the
    ASCII-least of equal ones; repaired_sha256 is of the repaired ``role:text`` lines.

    Null roles and texts are one space (so a null text is blank), a null conversation is one of its own, and turns that
    are all null have no gaps. Rows that agree in all are duplicates of one another. everyone: a table whose
    conversations are listed too; those without turns have zeros, an empty audit and the hash of an empty text. Empty
    tables give no rows; other columns are not read. Conversations of any length are cut into chunks; only their final
    audit and hash pass through one task each, as a stream.
    """
    spark = conversations.sparkSession
    with Scratch(spark) as scratch:
        keep = scratch.keep
        turns = prepared(conversations, conv_col, turn_col, role_col, text_col, keep)
        chunks = keep(chunks_of(turns))
        distinct, rules = grammar(chunks, keep)
        best = solved(chunks, keep(chunk_matrices(distinct, rules)))
        listed = (everyone if everyone is not None else conversations).select(F.col(conv_col).alias("conv")).distinct()
        zero = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
        best = keep(listed.unionByName(best, allowMissingColumns=True).groupBy("conv").agg(zero("illegal"), zero("cost"), F.coalesce(F.max("audit"), F.lit("")).alias("audit")))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind, conv, state, begun, out = None, None, None, False, []

            def seen(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                nonlocal kind
                for batch in source:
                    kind = batch.schema.field(0).type
                    yield batch

            def rows() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.string())], names=["conv", "repaired_sha256"])

            for c, edit, _, role, text in replayed(seen(batches)):
                if edit is None:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    if len(out) >= 10_000:
                        yield rows()
                        out = []
                    conv, state, begun = c, hashlib.sha256(), False
                else:
                    state.update((("\n" if begun else "") + f"{role}:{text}").encode())
                    begun = True
            if state is not None:
                out.append((conv, state.hexdigest()))
            if out:
                yield rows()

        hashes = applied(turns, best).mapInArrow(hashed, fields(turns, repaired_sha256="string"))
        number = {c: F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")}
        faults = turns.groupBy("conv", "turn").agg(*number.values()).groupBy("conv").agg(*number.values(), (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
        every = best.unionByName(faults, allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True).groupBy("conv")
        counted = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        out = every.agg(*[zero(c) for c in counted], F.max("audit").alias("audit"), F.max("repaired_sha256").alias("repaired_sha256"))
        return cut_lineage(out.withColumnRenamed("conv", conv_col))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with damage by crc32 of ``conv_id:turn``, modulo 20.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    return rows.drop("copy")
