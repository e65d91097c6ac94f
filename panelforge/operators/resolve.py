"""Scope filter and resolution of place codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import canonical, only_digits
from ..sources.shared import cut_lineage


def in_scope(codes: list[Column], states: list[Column], name: Column, code_prefix: str | None = None, state: str | None = None, state_code: str | None = None, target_name: str | None = None, whole_state: str = "DF") -> Column:
    """Whether a record belongs to a scope; without any filter all do.

    True if one of the codes has the prefix; else the state (letters or number) must match and, with it, the name must
    hold the target name, or only the state is asked for, or the state is ``whole_state``.
    """
    if not (code_prefix or state or target_name):
        return F.lit(True)
    hit = F.lit(False)
    if code_prefix:
        for c in codes:
            hit = hit | F.startswith(only_digits(c), F.lit(code_prefix))
    accepted = [s for s in ((state or "").upper(), state_code or "") if s]
    state_match = F.lit(True)
    if accepted:
        state_match = F.lit(False)
        for s in states:
            state_match = state_match | canonical(s).isin(*accepted)
    target = (target_name or "").strip().upper()
    by_name = F.contains(canonical(name), F.lit(target)) if target else F.lit(False)
    by_state = F.lit(bool(state) and not code_prefix and not target_name or (state or "").upper() == whole_state)
    return hit | state_match & (by_name | by_state)


def lookup_of(territory: DataFrame) -> DataFrame:
    """key (7: and a code, 6: and six digits) and place (code, name, uf, region), each key once.

    Of rows with one code the least by name, uf and region counts, of codes with the same six digits the greatest.
    """
    texts = territory.select(*[F.col(c).cast("string").alias(c) for c in ("code", "code6", "name", "uf", "region")]).where("code is not null")
    least = F.struct(*[x for c in ("name", "uf", "region") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(c))])
    one = texts.groupBy("code").agg(F.min(least).alias("n"), F.collect_set("code6").alias("six")).select("code", "n.name", "n.uf", "n.region", "six")
    place = F.struct("code", "name", "uf", "region")
    six = one.select(F.explode("six").alias("code6"), place.alias("place")).groupBy("code6").agg(F.max("place").alias("place"))
    return one.select(F.concat(F.lit("7:"), "code").alias("key"), place.alias("place")).unionByName(six.select(F.concat(F.lit("6:"), "code6").alias("key"), "place"))


def resolve_place(records: DataFrame, territory: DataFrame, codes: list[tuple[str, str]], states: list[str], fallback: tuple[str, str, str] = ("53", "DF", "5300108"), broadcast_rows: int = 50_000) -> DataFrame:
    """records with place_code, place_name, uf, region, place_rule and place_field; all null where nothing matches.

    codes: (name, column) in order of precedence. A code resolves by its first seven digits (direct_7d), else by its
    first six (prefix_6d_to_7d), else, if it starts with the fallback's prefix and a state column names its state, to the
    fallback's code (df_prefix_fallback), whether the territory has it or not. territory: code, code6, name, uf, region.

    The territory is read once. A lookup of at most broadcast_rows keys is one broadcast that all of a record's codes
    probe; a larger one is met by shuffles.
    """
    prefix, state, target = fallback
    is_state = F.lit(False)
    for s in states:
        is_state = is_state | canonical(F.col(s)).isin(state, prefix)
    lookup = cut_lineage(lookup_of(territory))
    size = lookup.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("key") == f"7:{target}", F.col("place"))).alias("place")).first()
    known = size["place"] or (target, None, None, None)
    capital = F.struct(*[F.lit(v).cast("string").alias(c) for v, c in zip(known, ("code", "name", "uf", "region"), strict=True)])
    small = F.broadcast if size["n"] <= broadcast_rows else (lambda d: d)
    out, found = records.drop("place_name"), []
    for i, (name, column) in enumerate(codes):
        out = out.withColumn(f"__d{i}", only_digits(F.col(column)))
        digits = F.col(f"__d{i}")
        hits = []
        for n, rule in ((7, "direct_7d"), (6, "prefix_6d_to_7d")):
            key = F.when(F.length(digits) >= n, F.concat(F.lit(f"{n}:"), F.substring(digits, 1, n)))
            out = out.withColumn(f"__k{i}{n}", key).join(small(lookup.select(F.col("key").alias(f"__r{i}{n}"), F.col("place").alias(f"__p{i}{n}"))), F.col(f"__k{i}{n}") == F.col(f"__r{i}{n}"), "left")
            hits.append((F.col(f"__r{i}{n}").isNotNull(), F.col(f"__p{i}{n}"), rule))
        hits.append((F.startswith(digits, F.lit(prefix)) & is_state, capital, "df_prefix_fallback"))
        found += [F.when(hit, F.struct(place.alias("place"), F.lit(rule).alias("rule"), F.lit(name).alias("field"))) for hit, place, rule in hits]
    place = F.col("__pick.place")
    added = {"place_code": place["code"], "place_name": place["name"]} | {f"place_{c}" if c in records.columns else c: place[c] for c in ("uf", "region")}
    added |= {"place_rule": F.col("__pick.rule"), "place_field": F.col("__pick.field")}
    kept = [c for c in records.columns if c != "place_name"]
    return out.withColumn("__pick", F.coalesce(*found)).select(*kept, *[v.alias(c) for c, v in added.items()])
