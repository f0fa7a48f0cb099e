"""Personal data: entities by pattern, and terms that disclose them, in DataFrame functions only.

Entities are e-mail addresses, IPv4 addresses, payment cards and telephone numbers.  A term can
disclose an entity that is masked: if the corpus shows that wherever the term occurs the entity
does, the term stands for the entity.  Let N count the distinct texts, c(e) those that mention
entity e, c(t) those that have the term t outside entities, and c(e,t) those that do both.  Then

    PMI(e,t) = ln(c(e,t) N / (c(e) c(t))),   IC(e) = ln(N / c(e)),

and PMI / IC is the share of e's information that t discloses (1: t occurs with e alone).  Terms
that disclose at least `generalise` of an entity are generalised wherever they occur, in documents
that do not mention the entity too, and those that disclose at least `remove` are removed.  A pair
must be seen in `support` texts in which the surroundings of e differ, so neither a single text nor
its copies make a term disclosing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone", "term")

#: Patterns that match as the plain ones
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+    ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card  [0-9]([\x20-]?[0-9])+ of 12 to 19 digits             phone \+[0-9][\x20().0-9-]+[0-9]
#: do, but in linear time and bounded stack: a run of characters is tried from its start alone, and a
#: card's length is part of its pattern.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++(?:[.][0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"[+][0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to hold a match.
_HINTS = {"email": "contains(_text, '@')", "ip": "contains(_text, '.')", "card": "true", "phone": "contains(_text, '+')"}
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = f"""aggregate(transform(sequence(1, length({_DIGITS})), i -> case when i % 2 = 1 then cast(substring(reverse({_DIGITS}), i, 1) as int)
  else 2 * cast(substring(reverse({_DIGITS}), i, 1) as int) - case when substring(reverse({_DIGITS}), i, 1) >= '5' then 9 else 0 end end), 0, (a, d) -> a + d) % 10 = 0"""
_TESTS = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and (length(ltrim('0', p)) < 3 or ltrim('0', p) <= '255'))",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) between 9 and 15",
}
_SPAN = "array<struct<s: int, k: int, e: int>>"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


#: Neighbours that are summed up at once where places are added up.
_RUN = 256


def _matches(text: str, pattern: str, keep: str = "true") -> str:
    """SQL array<struct<s, m>>: each match and its start in code points.  A match starts where the
    pieces and matches before it end; their lengths are summed up by runs, so that a text of many
    matches takes no time in proportion to their square."""
    p = _sql(pattern)
    add = "0, (a, x) -> a + x"
    return f"""element_at(transform(array(struct(regexp_extract_all({text}, {p}, 0) as ms, split({text}, {p}, -1) as ps)), b ->
      element_at(transform(array(struct(b.ms as ms, transform(b.ps, x -> length(x)) as pl, zip_with(b.ms, slice(b.ps, 1, size(b.ms)), (m, x) -> length(m) + length(x)) as ls)), c ->
        element_at(transform(array(case when size(c.ls) = 0 then array(0) else transform(sequence(0, (size(c.ls) - 1) div {_RUN}), r -> aggregate(slice(c.ls, r * {_RUN} + 1, {_RUN}), {add})) end), rs ->
          transform(filter(transform(c.ms, (m, i) -> struct(i as i, m as m)), x -> {keep}), x ->
            struct(aggregate(slice(rs, 1, x.i div {_RUN}), {add}) + aggregate(slice(c.ls, (x.i div {_RUN}) * {_RUN} + 1, x.i % {_RUN}), {add}) + c.pl[x.i] as s, x.m as m))), 1)), 1)), 1)"""


def base_spans() -> str:
    """SQL over _text: the entities' spans (start, kind's number, end), by start, then kind."""
    each = []
    for k, kind in enumerate(KINDS[:4]):
        p = _sql(_PATTERNS[kind])
        found = f"transform({_matches('_text', _PATTERNS[kind], _TESTS[kind])}, x -> struct(x.s as s, {k} as k, x.s + length(x.m) as e))"
        each.append(f"case when {_HINTS[kind]} and _text rlike {p} then {found} else cast(array() as {_SPAN}) end")
    return f"sort_array(concat({', '.join(each)}))"


#: Code points on each side of a mention whose whole words are its surroundings.
REACH = 60
SUPPORT = 3
GENERALISE = 0.9
REMOVE = 0.97
_TERM = r"\p{L}{3,}+"


def _keyed(docs: DataFrame) -> DataFrame:
    """(_hash, _text): equal texts have equal hashes."""
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))


def parsed(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(_hash, seen, terms), a row for each distinct text: its mentions of entities, each with a hash
    of its surroundings (entity, near), and the lower-case terms outside entities, each once."""
    texts = _keyed(docs).groupBy("_hash").agg(F.min("_text").alias("_text")).withColumn("_base", F.expr(base_spans()))
    left = f"case when x.s > {reach} then regexp_replace(substring(_text, x.s - {reach} + 1, {reach}), '^\\\\p{{L}}+', '') else substring(_text, 1, x.s) end"
    right = f"case when length(_text) - x.e > {reach} then regexp_replace(substring(_text, x.e + 1, {reach}), '\\\\p{{L}}+$', '') else substring(_text, x.e + 1, {reach}) end"
    seen = f"transform(_base, x -> struct(concat(x.k, ':', lower(substring(_text, x.s + 1, x.e - x.s))) as entity, xxhash64({left}, {right}) as near))"
    plain = """case when size(_base) = 0 then _text else aggregate(_base, struct(0 as p, '' as o),
      (a, x) -> case when x.e <= a.p then a else struct(x.e as p, concat(a.o, ' ', substring(_text, a.p + 1, greatest(0, x.s - a.p))) as o) end,
      a -> concat(a.o, ' ', substring(_text, a.p + 1))) end"""
    terms = f"array_distinct(regexp_extract_all(lower({plain}), {_sql(_TERM)}, 0))"
    return texts.select("_hash", F.expr(seen).alias("seen"), F.expr(terms).alias("terms"))


def disclosing_terms(texts: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """parsed() -> (entity, term, share) of terms that disclose at least `generalise` of an entity."""
    each = texts.where("size(seen) > 0").select("_hash", F.explode("seen").alias("m")).groupBy("_hash", "m.entity").agg(F.min("m.near").alias("near"))
    each = materialize(each, "mentions")
    near = each.groupBy("entity", "near").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("c_e"), F.count("*").alias("places"))
    # No pair of an entity of fewer surroundings can have enough.
    known = materialize(near.where(F.col("places") >= support).select("entity", "c_e"), "entities")
    held = each.join(known.select("entity"), "entity").join(texts.where("size(seen) > 0").select("_hash", "terms"), "_hash")
    by_place = held.select("entity", "near", F.explode("terms").alias("term")).groupBy("entity", "term", "near").agg(F.count("*").alias("n"))
    both = by_place.groupBy("entity", "term").agg(F.sum("n").alias("c_et"), F.count("*").alias("places")).where(F.col("places") >= support)
    both = materialize(both, "pairs")
    counts = materialize(texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c_t")), "terms")
    total = texts.count()
    if not total:
        return both.select("entity", "term", F.lit(0.0).alias("share")).where("false")
    scored = both.join(counts, "term").join(known, "entity").where(F.col("c_e") < total)
    n = F.log(F.lit(float(total)))
    share = (F.log("c_et") + n - F.log("c_e") - F.log("c_t")) / (n - F.log("c_e"))
    return scored.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)


def find(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs(doc_id, text, ...) -> (_row, _text, spans), a row for each row of docs: _row holds the
    row, _text its text (null: empty), spans its (s, k, e, gone), by start, then kind.

    k numbers KINDS; gone marks a term to be removed.  Term spans lie outside entities.  Repeated
    rows get equal spans.  An empty table gives an empty table."""
    texts = materialize(parsed(docs, reach), "texts")
    found = disclosing_terms(texts, support, generalise).groupBy("term").agg(F.max("share").alias("share"))
    found = materialize(found, "disclosing")
    hit = texts.select("_hash", F.explode("terms").alias("term")).join(found, "term")
    hit = hit.groupBy("_hash").agg(F.collect_list("term").alias("terms"), F.expr(f"collect_list(case when share >= {remove} then term end)").alias("gone"))
    hit = materialize(hit, "hit").withColumnRenamed("_hash", "_hash2")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    held = held.withColumn("_hash", F.xxhash64("_text"))
    both = held.join(hit, held["_hash"] == hit["_hash2"], "left")
    both = both.withColumn("_base", F.expr(base_spans()))
    words = f"""transform({_matches('_text', _TERM, 'array_contains(terms, lower(x.m))')}, x -> struct(x.s as s, 4 as k, x.s + length(x.m) as e, array_contains(gone, lower(x.m)) as gone))"""
    terms = f"case when terms is null then cast(array() as array<struct<s: int, k: int, e: int, gone: boolean>>) else filter({words}, w -> not exists(_base, b -> w.s < b.e and b.s < w.e)) end"
    return both.select("_row", "_text", F.expr(f"sort_array(concat(transform(_base, b -> struct(b.s as s, b.k as k, b.e as e, false as gone)), {terms}))").alias("spans"))


def report(docs: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans), a row for each row of docs."""
    out = find(docs, **limits).select(F.col("_row.doc_id").alias("doc_id"), "spans")
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    listed = lambda where: f"array_join(transform(filter(spans, x -> {where}), x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.k = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(F.expr(listed("x.k < 4")), 256).alias("base_sha256"), F.expr(listed("true")).alias("spans"))


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """docs with the entities and disclosing terms of `text` masked, all else as it was.

    An entity becomes <EMAIL>, <IP>, <CARD> or <PHONE>, a generalised term <TERM>, a removed one
    nothing; spans that overlap are masked as one, under the first one's name.  A null text stays
    null."""
    out = find(docs, **limits)
    mask = "array('<EMAIL>', '<IP>', '<CARD>', '<PHONE>', '<TERM>')"
    text = f"""aggregate(spans, struct(0 as p, '' as o), (a, x) -> case when x.e <= a.p then a else
      struct(x.e as p, concat(a.o, case when x.s >= a.p then concat(substring(_text, a.p + 1, x.s - a.p), case when x.gone then '' else {mask}[x.k] end) else '' end) as o) end,
      a -> concat(a.o, substring(_text, a.p + 1)))"""
    changed = F.expr(f"case when _row.text is null then cast(null as string) when size(spans) = 0 then _text else {text} end")
    return out.select(*[changed.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
