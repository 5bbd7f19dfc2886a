"""Secrets in texts: fixed forms, and strings that pass a battery of randomness tests.

The fixed forms are assignments to telling names, access key ids and long
hexadecimal runs. Beside them every other long run of letters, digits and
``+/_-`` with both digits and letters is a candidate. Its encoding is inferred
from its characters (hexadecimal, base 32, alphanumeric, base 64); under that
alphabet three tests ask whether it could be random: chi-squared of the symbol
counts, runs above and below the middle of the alphabet, and serial
correlation of neighbouring symbols. The three p-values are combined by
Fisher's method. The candidates of one length class are compared with each
other: where the Benjamini-Hochberg procedure says that a string is not random, at the given false-discovery rate over all
candidates of that class in the corpus, it is dropped; the rest is reported.

Everything is DataFrame expressions: one scan finds the spans, a histogram of
p-values with a bounded number of rows gives the limits.

Defined results: a null text is an empty one and has no spans; repeated rows
and null ids are scanned like others and count in the histogram. Positions are
code points, ends exclusive. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import with_row
from quadrille.session import materialise

# Fixed forms (given). Group 2 of an assignment has to have six characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# A longer run of the same characters is one match, so the bound can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}=*"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
RATE = 0.05
# p-values are compared in steps of a twentieth of a decade, down to 1e-20.
STEPS, LAST_STEP = 20, 400
# Matches whose positions are summed up in one go.
RUN = 256


def _quoted(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def matches(text: str, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches with their positions: array<struct<s, e, m>>; ``m`` is the group.

    The pieces between matches and the matches themselves add up to the text,
    so their lengths give the positions.
    """
    p = _quoted(pattern)
    zipped = f"transform(regexp_extract_all({text}, {p}, 0), (m, i) -> struct(length(m) as n, i as i))"
    # One number per match: what lies before it and after the previous one, and its own length.
    expression = f"""
      case when not ({text} rlike {p}) then array() else
      aggregate(array(struct(split({text}, {p}, -1) as gaps, {zipped} as hits, regexp_extract_all({text}, {p}, {group}) as groups)),
        cast(array() as array<struct<s:int,e:int,m:string>>),
        (none, x) -> flatten(aggregate(
          sequence(0, cast((size(x.hits) - 1) div {RUN} as int)),
          struct(0 as at, cast(array() as array<array<struct<s:int,e:int,m:string>>>) as out),
          (acc, b) -> aggregate(
            array(aggregate(slice(x.hits, b * {RUN} + 1, {RUN}),
              struct(acc.at as at, cast(array() as array<struct<s:int,e:int,m:string>>) as own),
              (a, h) -> struct(
                a.at + length(x.gaps[h.i]) + h.n as at,
                concat(a.own, array(struct(a.at + length(x.gaps[h.i]) as s, a.at + length(x.gaps[h.i]) + h.n as e, x.groups[h.i] as m))) as own))),
            acc, (o, part) -> struct(part.at as at, concat(o.out, array(part.own)) as out)),
          acc -> acc.out))) end"""
    return F.expr(expression)


def _tail(z: str) -> str:
    """The normal distribution's upper tail, to about 1e-4."""
    return f"(1.0D / (1.0D + exp(1.5976D * ({z}) + 0.07056D * ({z}) * ({z}) * ({z}))))"


def tested(candidates: str) -> Column:
    """Candidates with encoding, number of symbols and combined p-value: array<struct<s, e, encoding, n, p>>."""
    encoding = """case when lower(c.m) rlike '^[0-9a-f]+$' then 'hex' when c.m rlike '^[A-Z2-7]+=*$' then 'base32'
                       when c.m rlike '^[A-Za-z0-9]+$' then 'alnum' else 'base64' end"""
    symbols = """case when lower(c.m) rlike '^[0-9a-f]+$' then lower(c.m) else translate(rtrim('=', c.m), '-_', '+/') end"""
    alphabet = "case x.encoding " + " ".join(f"when '{k}' then '{v}'" for k, v in ALPHABETS.items()) + " end"
    size = "case x.encoding " + " ".join(f"when '{k}' then {len(v)}" for k, v in ALPHABETS.items()) + " end"
    # Sums over the symbols: of values, squares, products of neighbours; symbols above the middle, changes of side.
    sums = f"""aggregate(split(x.t, ''), struct(0L as v, 0L as q, 0L as w, 0L as above, 0L as changes, -1 as last, -1 as first),
      (a, ch) -> aggregate(array(instr({alphabet}, ch) - 1), a, (o, k) -> struct(
        o.v + k as v, o.q + k * k as q, o.w + if(o.last < 0, 0, o.last * k) as w, o.above + if(2 * k >= {size}, 1, 0) as above,
        o.changes + if(o.last >= 0 and (2 * o.last >= {size}) <> (2 * k >= {size}), 1, 0) as changes, k as last, if(o.first < 0, k, o.first) as first)))"""
    squares = "aggregate(array_distinct(split(x.t, '')), 0L, (n, ch) -> n + (x.n - length(replace(x.t, ch, ''))) * (x.n - length(replace(x.t, ch, ''))))"
    steps = [
        f"transform({candidates}, c -> struct(c.s as s, c.e as e, {encoding} as encoding, {symbols} as t))",
        "transform({0}, x -> struct(x.s as s, x.e as e, x.encoding as encoding, x.t as t, length(x.t) as n))",
        f"transform({{0}}, x -> struct(x.s as s, x.e as e, x.encoding as encoding, x.n as n, {size} as m, {squares} as sq, {sums} as f))",
        # The three statistics as normal deviates.
        """transform({0}, x -> struct(x.s as s, x.e as e, x.encoding as encoding, x.n as n,
             (pow(greatest(1.0D * x.m * x.sq / x.n - x.n, 0.0D) / (x.m - 1), 1.0D / 3) - (1 - 2.0D / (9 * (x.m - 1)))) / sqrt(2.0D / (9 * (x.m - 1))) as z1,
             case when x.f.above = 0 or x.f.above = x.n then sqrt(cast(x.n as double)) else
               abs(x.f.changes - 2.0D * x.f.above * (x.n - x.f.above) / x.n)
               / sqrt(greatest(2.0D * x.f.above * (x.n - x.f.above) * (2.0D * x.f.above * (x.n - x.f.above) - x.n) / (1.0D * x.n * x.n * (x.n - 1)), 1e-9)) end as z2,
             case when x.n * x.f.q = x.f.v * x.f.v then sqrt(cast(x.n as double)) else
               abs((x.f.w - (1.0D * x.f.v / x.n) * (2 * x.f.v - x.f.first - x.f.last) + (x.n - 1) * (1.0D * x.f.v / x.n) * (1.0D * x.f.v / x.n))
               / (x.f.q - 1.0D * x.f.v * x.f.v / x.n)) * sqrt(cast(x.n as double)) end as z3))""",
        f"""transform({{0}}, x -> struct(x.s as s, x.e as e, x.encoding as encoding, x.n as n,
             -ln(greatest({_tail('x.z1')}, 1e-30)) - ln(greatest(least(2 * {_tail('x.z2')}, 1.0D), 1e-30)) - ln(greatest(least(2 * {_tail('x.z3')}, 1.0D), 1e-30)) as l))""",
        # Fisher: six degrees of freedom have a closed form.
        "transform({0}, x -> struct(x.s as s, x.e as e, x.encoding as encoding, x.n as n, exp(-x.l) * (1 + x.l + x.l * x.l / 2) as p))",
    ]
    out = steps[0]
    for step in steps[1:]:
        out = step.replace("{0}", out)
    return F.expr(out)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, base, candidates) of each document, without its text in ``row``."""
    rows = with_row(docs, text, drop_text=True)
    rows = rows.select("row", matches("text", ASSIGN, 2).alias("assign"), matches("text", ACCESS).alias("access"),
                       matches("text", HEX).alias("hex"), matches("text", CANDIDATE).alias("found"))
    span = lambda kind, cond="true": F.expr(f"transform(filter({kind}, x -> {cond}), x -> struct(x.s as s, {KINDS.index(kind)} as k, x.e as e))")
    base = F.array_sort(F.concat(span("assign", f"length(x.m) >= {ASSIGN_LEAST}"), span("access"), span("hex")))
    rows = rows.select("row", base.alias("base"), "found")
    # Both digits and letters, and nothing that a fixed form covers already.
    apart = F.expr("filter(found, x -> x.m rlike '[0-9]' and x.m rlike '[A-Za-z]' and not exists(base, b -> b.s <= x.s and x.e <= b.e))")
    return rows.select("row", "base", apart.alias("found")).select("row", "base", tested("found").alias("candidates"))


def _class(n: str) -> str:
    return f"length(bin({n}))"


def _step(p: str) -> str:
    return f"cast(least({LAST_STEP}, floor({STEPS} * -log10(greatest({p}, 1e-30)) + 1e-9)) as int)"


def limits(rows: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per length class the first step of p-values at which randomness is rejected."""
    histogram = (rows.select(F.explode("candidates").alias("c"))
                 .groupBy(F.expr(_class("c.n")).alias("class"), F.expr(_step("c.p")).alias("step")).agg(F.count("*").alias("n")))
    # At most 401 steps in each of 31 classes.
    counts: dict[int, dict[int, int]] = {}
    for r in histogram.collect():
        counts.setdefault(r["class"], {})[r["step"]] = r["n"]
    out = {}
    for k, by_step in counts.items():
        total, beyond = sum(by_step.values()), 0
        for step in sorted(by_step, reverse=True):
            beyond += by_step[step]
            if 10 ** (-step / STEPS) <= rate * beyond / total:
                out[k] = step
    return out


def secret_spans(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """(row, base, spans): spans as array<struct<s, k, e>> by start, then kind; ``base`` are the fixed forms among them."""
    rows = materialise(scanned(docs, text), "secret_candidates")
    dropped = " or ".join(f"({_class('x.n')} = {k} and {_step('x.p')} >= {step})" for k, step in sorted(limits(rows, rate).items())) or "false"
    random = F.expr(f"transform(filter(candidates, x -> not ({dropped})), x -> struct(x.s as s, {KINDS.index('random')} as k, x.e as e))")
    return rows.select("row", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.s, x.e)), ',')")


def report(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    number = lambda kind: F.expr(f"size(filter(base, x -> x.k = {KINDS.index(kind)}))").cast("long").alias(f"n_{kind}")
    return found.select(F.col(f"row.{id_column}").alias("doc_id"), number("assign"), number("access"), number("hex"),
                        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
