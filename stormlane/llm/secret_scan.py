"""Secret scan with DataFrame functions only.

Three fixed kinds are found by pattern. Three more come from sliding-window Shannon entropy, one per character class: long runs
of the class are candidates, a window moves over each one sign at a time, its sign counts change by minus one for the sign that
leaves and plus one for the sign that enters, and the sum of c*log2(c) over them is corrected for those two. A candidate is reported from the start of its first window
over the threshold to the end of its last. Candidates on the allow-list, and spans inside a span of a fixed kind, are not;
marked examples are blanked before candidates are sought. A step costs as much as the candidate has distinct signs (65 at
most), since the counts are one array that is written anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlane.llm.common import table

# The kinds in listed order. The keyword of an assignment counts in either case; the length of its value is
# checked afterwards, as a short value still takes its place. For the others a longer run is the same as a checked one.
_EITHER = {word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")}
ASSIGN = f"({'|'.join(_EITHER.values())})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
MIN_VALUE = 12


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``candidate`` that match all of ``needs``; a window of ``window`` signs with ``bits`` or more is a finding."""

    kind: str
    candidate: str
    needs: tuple[str, ...]
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_hex", "[0-9A-Fa-f]{24,}", ("[0-9]", "[A-Fa-f]"), 24, 3.017),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_=-]{20,}", ("[0-9]", "[a-z]", "[A-Z]"), 20, 3.617),
    EntropyClass("entropy_base36", "[A-Z0-9]{20,}|[a-z0-9]{20,}", ("[0-9]", "[A-Za-z]"), 20, 3.617),
)
#: Whole candidates that are no secrets: UUIDs, and words or numbers joined by separators.
ALLOW = (
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^([A-Z]?[a-z]+|[0-9]+)([-_/=+]+([A-Z]?[a-z]+|[0-9]+))*$",
)
#: A marked example: letters and digits, between separators, that have the word in them. Entropy does not look at these; what
#: stands beside them is a candidate of its own.
EXAMPLE_WORDS = "EXAMPLE|example|Example"
EXAMPLE = f"[A-Za-z0-9]*({EXAMPLE_WORDS})[A-Za-z0-9]*"
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
_SPAN = "array<struct<start:int,rank:int,end:int>>"
_FOUND = "array<struct<start:int,hit:string,value:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches with their starts: the texts between matches and the matches add up to the places.

    The sums run over blocks of about the square root of their number, so a text with very many matches isn't copied once
    for each of them.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    behind = lambda at, part: at + F.length(part["before"]) + F.coalesce(F.length(part["hit"]), F.lit(0))

    def step(acc, part):
        one = F.array(F.struct((acc["at"] + F.length(part["before"])).alias("start"), part["hit"].alias("hit"), part["value"].alias("value")))
        return F.struct(behind(acc["at"], part).alias("at"), F.when(part["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], one)).alias("found"))

    def in_block(block, offset):
        return F.aggregate(block, F.struct(offset.alias("at"), F.array().cast(_FOUND).alias("found")), step, lambda acc: acc["found"])

    def in_blocks(blocks):
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), behind))
        offsets = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(_let(offsets, lambda at: F.transform(blocks, lambda block, number: in_block(block, F.get(at, number)))))

    def all_parts(found):
        size = F.ceil(F.sqrt(F.size(found))).cast("int")
        return _let(F.transform(F.sequence(F.lit(1), F.size(found), size), lambda first: F.slice(found, first, size)), in_blocks)

    return F.when(text.rlike(pattern), _let(parts, all_parts)).otherwise(F.array().cast(_FOUND))


def _unmarked(text: Column) -> Column:
    """The text with spaces in place of marked examples, so that all else keeps its place."""
    pattern = f"(?<![A-Za-z0-9]){EXAMPLE}"  # from a part's start only, so that long runs aren't tried from each sign
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    blanked = F.transform(parts, lambda p: F.concat(p["before"], F.coalesce(F.rpad(F.lit(""), F.length(p["hit"]), " "), F.lit(""))))
    return F.when(text.rlike(EXAMPLE_WORDS), F.array_join(blanked, "")).otherwise(text)


def _spans(found: Column, kind: str) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(found, lambda f: F.struct(f["start"].alias("start"), rank.alias("rank"), (f["start"] + F.length(f["hit"])).alias("end"))).cast(_SPAN)


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def _signs(text: Column) -> Column:
    """The distinct signs of a candidate, and for each of its signs which of them it is, from 1."""
    signs = F.filter(F.split(text, ""), lambda x: x != "")
    return _let(F.struct(signs.alias("all"), F.array_distinct(signs).alias("kinds")), lambda s: F.struct(s["kinds"].alias("kinds"), F.transform(s["all"], lambda x: F.array_position(s["kinds"], x).cast("int")).alias("places")))


def _hot_part(signs: Column, c: EntropyClass) -> Column:
    """(first, last) starts of the windows of a candidate (see ``_signs``) with enough entropy, from 0; (-1, -1) if there are none."""
    most = F.lit(c.window * (F.log2(F.lit(float(c.window))) - F.lit(c.bits)))  # of the sum of c*log2(c)
    places = signs["places"]
    opening = F.transform(signs["kinds"], lambda _, i: F.size(F.filter(F.slice(places, 1, c.window), lambda p: p == i + 1)))
    now = lambda total, at: F.when(total <= most, at)

    def step(acc, at):
        leaving, entering = F.element_at(places, at), F.element_at(places, at + c.window)
        gone, come = F.element_at(acc["counts"], leaving), F.element_at(acc["counts"], entering)
        moved = acc["total"] - _weight(gone) + _weight(gone - 1) - _weight(come) + _weight(come + 1)
        counts = F.transform(acc["counts"], lambda n, i: n - F.when(i + 1 == leaving, 1).otherwise(0) + F.when(i + 1 == entering, 1).otherwise(0))
        changed = F.struct(F.when(leaving == entering, acc["counts"]).otherwise(counts).alias("counts"), F.when(leaving == entering, acc["total"]).otherwise(moved).alias("total"))

        def noted(new):
            first = F.when(acc["first"] < 0, F.coalesce(now(new["total"], at), acc["first"])).otherwise(acc["first"])
            return F.struct(new["counts"].alias("counts"), new["total"].alias("total"), first.alias("first"), F.coalesce(now(new["total"], at), acc["last"]).alias("last"))

        return _let(changed, noted)

    def slid(counts):
        weight = F.aggregate(counts, F.lit(0.0), lambda s, n: s + _weight(n))
        place = F.coalesce(now(weight, F.lit(0)), F.lit(-1))
        start = F.struct(counts.alias("counts"), weight.alias("total"), place.alias("first"), place.alias("last"))
        steps = F.when(F.size(places) > c.window, F.sequence(F.lit(1), F.size(places) - c.window)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return _let(opening, slid)


def _entropy_spans(text: Column, c: EntropyClass, allow: tuple[str, ...]) -> Column:
    def eligible(f):
        good = F.lit(True)
        for pattern in c.needs:
            good = good & f["hit"].rlike(pattern)
        for pattern in allow:
            good = good & ~f["hit"].rlike(pattern)
        return good

    candidates = F.transform(F.filter(_found(text, c.candidate), eligible), lambda f: F.struct(f["start"].alias("start"), _signs(f["hit"]).alias("signs")))
    parts = F.transform(candidates, lambda f: F.struct(f["start"].alias("start"), _hot_part(f["signs"], c).alias("hot")))
    rank = F.lit(KINDS.index(c.kind))
    hot = F.filter(parts, lambda p: p["hot"]["first"] >= 0)
    return F.transform(hot, lambda p: F.struct((p["start"] + p["hot"]["first"]).alias("start"), rank.alias("rank"), (p["start"] + p["hot"]["last"] + c.window).alias("end"))).cast(_SPAN)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def span_columns(df: DataFrame, text: str, found: str = "_found", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``df`` with one more column ``found``: struct of the base spans and of all spans, both by start, then kind.

    A null text counts as empty. ``found`` must not be a column of ``df``.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    assign = F.filter(_found(body, ASSIGN, 2), lambda f: F.length(f["value"]) >= MIN_VALUE)
    base = F.array_sort(F.concat(_spans(assign, "assign"), _spans(_found(body, ACCESS), "access"), _spans(_found(body, HEX), "hex")))
    more = _let(_unmarked(body), lambda text: F.concat(*[_entropy_spans(text, c, allow) for c in classes]))
    out = df.withColumn(found, F.struct(base.alias("base"), more.alias("more")))
    fresh = F.filter(F.col(found)["more"], lambda s: ~F.exists(F.col(found)["base"], lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    return out.withColumn(found, F.struct(F.col(found)["base"].alias("base"), F.array_sort(F.concat(F.col(found)["base"], fresh)).alias("spans")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(id, base, spans) per row of ``docs``: arrays of (start, rank of the kind in ``KINDS``, end), in code points, end exclusive.

    Null and empty texts have no spans; null ids and repeated rows are kept; other columns are left out; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return span_columns(rows, "text", "found", classes, allow).select("id", "found.base", "found.spans")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, overlapping ones together, replaced by ``mark``; a null text stays null."""

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when((s["start"] >= acc["at"]) & ~((s["start"] == acc["at"]) & (acc["at"] > 0)), F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets of its texts replaced by ``mark``: same rows and columns, whatever their names."""
    name = "_found"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return span_columns(docs, text_col, name).withColumn(text_col, redacted(F.col(text_col), F.col(name)["spans"], mark)).drop(name)


def op5_secret_scan(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = [("assign", ASSIGN, 2, f"length(value) >= {MIN_VALUE}"), ("access", ACCESS, 0, "true"), ("hex", HEX, 0, "true")]
    parts = []
    for kind, pattern, group, keep in [*kinds, *((c.kind, c.candidate, 0, " AND ".join([*(f"regexp_matches(hit, {quoted(n)})" for n in c.needs), *(f"NOT regexp_matches(hit, {quoted(a)})" for a in ALLOW)])) for c in CLASSES)]:
        p, body = quoted(pattern), "body" if kind in KINDS[:3] else "unmarked"
        parts.append(f"""SELECT row_no, {KINDS.index(kind)} AS kind, "start", hit FROM (
  SELECT row_no, hits[i] AS hit, vals[i] AS value, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS "start"
  FROM (SELECT row_no, hits, pieces, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT row_no, regexp_extract_all({body}, {p}) AS hits, regexp_extract_all({body}, {p}, {group}) AS vals, string_split_regex({body}, {p}) AS pieces FROM docs)))
  WHERE {keep}""")
    fixed, loose = parts[:3], parts[3:]
    hot = []
    for c, part in zip(CLASSES, loose):
        hot.append(f"""SELECT row_no, kind, min("start" + w) AS "start", max("start" + w + {c.window}) AS "end" FROM (
  SELECT row_no, kind, "start", w, sum(-(n / {c.window}.0) * log2(n / {c.window}.0)) AS bits FROM (
    SELECT row_no, kind, "start", w, sign, count(*) AS n FROM (
      SELECT row_no, kind, "start", w, unnest(string_split(substr(hit, CAST(w + 1 AS BIGINT), {c.window}), '')) AS sign FROM (
        SELECT *, unnest(range(0, length(hit) - {c.window} + 1)) AS w FROM ({part}))) GROUP BY ALL) GROUP BY ALL)
  WHERE bits >= {c.bits} GROUP BY row_no, kind, "start\"""")
    names = f"[{', '.join(map(quoted, KINDS))}]"
    text = f"""{names}[kind + 1] || ':' || "start" || ':' || "end\""""
    unmarked = "array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || repeat(' ', coalesce(length(hits[i]), 0))), '')"
    return f"""WITH docs AS (SELECT row_no, doc_id, body, {unmarked} AS unmarked FROM (SELECT *, string_split_regex(body, {quoted(EXAMPLE)}) AS pieces, regexp_extract_all(body, {quoted(EXAMPLE)}) AS hits FROM (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents))),
base AS (SELECT row_no, kind, "start", "start" + length(hit) AS "end" FROM ({' UNION ALL '.join(fixed)})),
hot AS ({' UNION ALL '.join(hot)}),
more AS (SELECT * FROM hot h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_no = h.row_no AND b."start" <= h."start" AND b."end" >= h."end")),
b AS (SELECT row_no, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h, string_agg({text}, ',' ORDER BY "start", kind) AS s FROM base GROUP BY row_no),
s AS (SELECT row_no, string_agg({text}, ',' ORDER BY "start", kind) AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY row_no)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(s.s, '') AS spans
FROM docs LEFT JOIN b USING (row_no) LEFT JOIN s USING (row_no)"""


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE_SQL = {"op5_secret_scan": _sql()}
