"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans (assignments, access ids, hexadecimal runs) are reported as they are. Weak parts (login names,
short or unnamed secrets, endpoints) are common in clean text, so they are reported only where complementary
parts co-occur: parts are linked within `SCOPE` code points of the same text. A weak identifier needs a secret,
a weak secret an identifier, and an endpoint both.

The scope of a link never leaves a text, so the interval join runs inside each row: both sides' starts and the
ends of the asking parts are put in order, and one sweep carries the greatest end of each role so far. No row is
shuffled or written for it. Positions come from the pieces between matches (split) and the matches themselves.

A sweep appends to arrays of at most `BLOCK` elements, which start from the states of a first pass over whole
blocks; so a text of n matches costs n times `BLOCK` steps at most, and not n times n.

Edge cases: null and empty texts have no spans; very long texts are one row each and cost in proportion to their
length and matches; repeated rows get equal rows; of spans that start together the kind listed first comes first;
weak parts that overlap a base span are part of it and not reported again; an empty table gives an empty result;
other columns are ignored, whatever their names (`redact` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 24 and more, which are the matches of [0-9a-f]+ that are long enough.
HEX = r"[0-9a-f]{24,}"
LOGIN = r"""(?i)(user|username|user_name|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+"""
MIXED = r"[A-Za-z0-9+/]{20,}={0,2}"
ENDPOINT = r"""(?i)(https?|ftps?|ssh|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+"""
#: Least characters: group 2 of an assignment, an access id, a hexadecimal run.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Code points between parts of one credential.
SCOPE = 200
KINDS = ("assign", "access", "hex", "login", "short", "mixed", "endpoint")
#: Elements of an array that one step of a sweep appends to.
BLOCK = 128
#: An assignment has one of these.
_SET = "(contains(text, '=') or contains(text, ':'))"
#: A span: code points, kind, and the bytes of it.
_SPAN = "struct<start:int,kind:int,end:int,low:int,high:int>"
_NONE = f"cast(array() as array<{_SPAN}>)"
#: Below every position less SCOPE.
_NOWHERE = -(1 << 30)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(**bound: str) -> str:
    """SQL that evaluates each expression once for those after it: let(a=.., b=.., value=..)."""
    (name, value), *rest = bound.items()
    return f"element_at(transform(array({value}), {name} -> {let(**dict(rest))}), 1)" if rest else value


def sweep(items: str, zero: str, kind: str, step: str) -> str:
    """SQL of the states after each element of an array, from `zero` of type `kind`, by `step` of `s` and `x`."""
    after = let(s="acc.s", n=step, value="struct(n as s, concat(acc.out, array(n)) as out)")
    return let(
        a=items,
        blocks=f"transform(sequence(0, cast(greatest(size(a) - 1, 0) div {BLOCK} as int)), k -> slice(a, k * {BLOCK} + 1, {BLOCK}))",
        begins=f"aggregate(blocks, struct({zero} as s, cast(array() as array<{kind}>) as begins), (acc, b) -> struct(aggregate(b, acc.s, (s, x) -> {step}) as s, concat(acc.begins, array(acc.s)) as begins), acc -> acc.begins)",
        value=f"flatten(transform(blocks, (b, k) -> aggregate(b, struct(get(begins, k) as s, cast(array() as array<{kind}>) as out), (acc, x) -> {after}, acc -> acc.out)))",
    )


def matches(pattern: str, kind: int, hint: str, condition: str = "true") -> Column:
    """Spans of the leftmost non-overlapping matches of `text` that satisfy a condition on `f`; none where the cheaper hint does not hold."""
    p = _quoted(pattern)
    step = "struct(s.end + length(x.before) as start, s.end + length(x.before) + length(x.found) as end, s.high + octet_length(x.before) as low, s.high + octet_length(x.before) + octet_length(x.found) as high)"
    placed = let(
        m=f"regexp_extract_all(text, {p}, 0)",
        pieces=f"zip_with(slice(split(text, {p}, -1), 1, size(m)), m, (before, found) -> struct(before, found))",
        places=sweep("pieces", "struct(0 as start, 0 as end, 0 as low, 0 as high)", "struct<start:int,end:int,low:int,high:int>", step),
        value=f"transform(filter(zip_with(places, m, (at, f) -> struct(at, f)), y -> {condition.replace('$', 'y.f')}), y -> struct(y.at.start as start, {kind} as kind, y.at.end as end, y.at.low as low, y.at.high as high))",
    )
    return F.expr(f"case when {hint} then {placed} else {_NONE} end")


def _apart() -> str:
    """SQL of the spans of `weak` that no span of `base` overlaps."""
    # Of the base spans that start before a part's end, one overlaps it if the greatest end of them lies behind its start.
    events = "array_sort(concat(transform(weak, x -> struct(x.end as at, 0 as rank, x as span)), transform(base, x -> struct(x.start as at, 1 as rank, x as span))))"
    return let(
        e=events,
        ends=sweep("e", f"struct({_NOWHERE} as end)", "struct<end:int>", "struct(case when x.rank = 1 then greatest(s.end, x.span.end) else s.end end as end)"),
        value="transform(filter(zip_with(e, ends, (x, y) -> struct(x, y)), z -> z.x.rank = 0 and z.y.end <= z.x.span.start), z -> z.x.span)",
    )


def _linked(between: str) -> str:
    """SQL of the spans of `weak` whose complementary parts among `base` and `weak` co-occur in their scope.

    The scope is of the gap between parts, which is 0 where they overlap, or of their starts (`between`: gaps, starts).
    """
    high = "x.end" if between == "gaps" else "x.start"
    # Of the parts of a role that begin before a part's scope ends, one is near if the greatest end of them is.
    role = "case when x.kind in (1, 3) then 1 when x.kind = 6 then 3 else 2 end"
    here = f"transform(concat(base, weak), x -> struct(x.start as at, 0 as asks, {role} as role, {high} as high, x as span))"
    asked = f"transform(weak, x -> struct({high} + {SCOPE} as at, 1 as asks, {role} as role, {high} as high, x as span))"
    step = "struct(case when x.asks = 0 and x.role = 1 then greatest(s.identifier, x.high) else s.identifier end as identifier, case when x.asks = 0 and x.role = 2 then greatest(s.secret, x.high) else s.secret end as secret)"
    near = "z.y.{} >= z.x.span.start - " + str(SCOPE)
    found = f"case z.x.role when 1 then {near.format('secret')} when 2 then {near.format('identifier')} else {near.format('identifier')} and {near.format('secret')} end"
    return let(
        e=f"array_sort(concat({here}, {asked}))",
        ends=sweep("e", f"struct({_NOWHERE} as identifier, {_NOWHERE} as secret)", "struct<identifier:int,secret:int>", step),
        value=f"transform(filter(zip_with(e, ends, (x, y) -> struct(x, y)), z -> z.x.asks = 1 and {found}), z -> z.x.span)",
    )


def found(rows: DataFrame, between: str) -> DataFrame:
    """rows (text, ..) with `base` and `extra`: sorted base spans, and the weak ones that are linked."""
    value = f"length(regexp_extract($, {_quoted(ASSIGN)}, 2))"
    return (
        rows.withColumn("_assign", matches(ASSIGN, 0, f"{_SET} and text rlike {_quoted(ASSIGN)}", f"{value} >= {LEAST_VALUE}"))
        .withColumn("_access", matches(ACCESS, 1, "contains(text, 'AKIA')", f"length($) >= {LEAST_ACCESS}"))
        .withColumn("_hex", matches(HEX, 2, f"text rlike {_quoted(HEX)}", f"length($) >= {LEAST_HEX}"))
        .withColumn("_short", matches(ASSIGN, 4, f"{_SET} and text rlike {_quoted(ASSIGN)}", f"{value} < {LEAST_VALUE}"))
        .withColumn("_login", matches(LOGIN, 3, f"{_SET} and text rlike {_quoted(LOGIN)}"))
        .withColumn("_mixed", matches(MIXED, 5, "text rlike '[0-9]' and text rlike '(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20}'", "$ rlike '[0-9]' and $ rlike '[A-Z]' and $ rlike '[a-z]'"))
        .withColumn("_endpoint", matches(ENDPOINT, 6, "contains(text, '://')"))
        .withColumn("base", F.expr("array_sort(concat(_assign, _access, _hex))"))
        .withColumn("weak", F.expr("concat(_login, _short, _mixed, _endpoint)"))
        .withColumn("weak", F.expr(f"case when size(weak) = 0 or size(base) = 0 then weak else {_apart()} end"))
        .withColumn("extra", F.expr(f"case when size(weak) > 0 then {_linked(between)} else {_NONE} end"))
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")


def scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", between: str = "starts") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked (`between`: see `_linked`; the query's SQL has starts)."""
    own = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = found(own, between).select("doc_id", "base", "extra")
    every = F.array_sort(F.concat("base", "extra"))
    return held.select("doc_id", *[_count(k) for k in range(3)], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(every).alias("spans"), F.size("extra").cast("bigint").alias("n_linked"))


def redact(documents: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """documents with the spans of their texts replaced by a mask; texts without spans stay as they are.

    Spans that overlap or touch are one mask.
    """
    names = documents.columns
    renamed = documents.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    text = f"c{names.index(text_col)}"
    held = found(renamed.withColumn("text", F.coalesce(F.col(text).cast("string"), F.lit(""))), "gaps")
    # By bytes, which are cut out without counting characters from the start.
    masked = let(
        every="array_sort(concat(base, extra))",
        ends=sweep("every", "struct(0 as high)", "struct<high:int>", "struct(greatest(s.high, x.high) as high)"),
        raw="cast(text as binary)",
        before="transform(every, (x, i) -> case when i = 0 then 0 else get(ends, i - 1).high end)",
        kept=f"transform(every, (x, i) -> case when i = 0 or x.low > get(before, i) then concat(cast(substring(raw, get(before, i) + 1, x.low - get(before, i)) as string), {_quoted(mask)}) else '' end)",
        value="concat(array_join(kept, ''), cast(substring(raw, element_at(ends, -1).high + 1) as string))",
    )
    done = F.expr(f"case when size(base) + size(extra) > 0 then {masked} else {text} end")
    return held.select(*[(done if f"c{i}" == text else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
