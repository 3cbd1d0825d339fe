"""Personal data by weak supervision, as DataFrame expressions only.

Base spans (email, ip, card, phone) come from fixed patterns with their checks.
Further kinds are found by weak supervision:

1. a wide pattern proposes candidates (``CANDIDATES``);
2. labelers of three families vote +1, -1 or 0 on each candidate: *regex*
   (known shapes of keys and numbers), *gazetteer* (word lists for the word
   before the candidate) and *context* (assignment signs, quotes, neighbours);
3. Spark counts the candidates by vote and feature pattern.  That table is
   bounded by the number of patterns, not by the data, and goes to the driver,
   where expectation-maximisation estimates each labeler's reliability (one
   two-class confusion table each, labelers independent given the class);
4. a logistic span classifier is trained on the candidates' features against
   the posterior labels and written as one Column expression, which decides
   the candidates of every text.

No Python runs on the executors.  Nothing is shuffled but the pattern counts.

Positions are code points.  They come from splitting the text at the pattern:
the pieces between matches and the matches alternate, so running sums of their
lengths are the offsets.  Sums, overlap tests and redaction take time in
proportion to a text's matches (times a logarithm), however many one text has.  Patterns use possessive repeats and start only where
a run starts (or where the last match ended), which leaves the leftmost
non-overlapping matches unchanged but keeps long runs linear.

Defined results: null and empty texts have no spans; repeated rows each get
their own; input columns stay, except those named like an output; an empty table
gives no row; of spans that start together the shorter is first, then by kind.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import let, let_all

BASE_KINDS = ("email", "ip", "card", "phone")

# The base patterns.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without these can't hold a match: spares the position work.
BASE_GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
NO_SPANS = "array<struct<kind:string,start:int,end:int>>"

# Wide patterns of the learned kinds.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{8,}+",
    "number": r"(?<![A-Za-z0-9+.()-])\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])",
}
CANDIDATE_GATES = {
    "secret": lambda t: t.rlike(r"[0-9]"),
    "number": lambda t: t.rlike(r"[0-9]{3}-[0-9]{4}"),
}
KINDS = (*BASE_KINDS, *CANDIDATES)

# Gazetteers for the word before a candidate, per kind.
CUE_WORDS = {
    "secret": "token password passwd pwd secret key apikey api_key auth bearer credential credentials access".split(),
    "number": "phone tel call mobile fax cell telephone contact text".split(),
}
# Shapes that a key or number of each kind has.
SHAPES = {
    "secret": r"^(?:AKIA[0-9A-Z]{16}|(?=[0-9]*[a-f])(?:[0-9a-f]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})|sk[_-][A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{36})$",
    "number": r"^\(?[2-9][0-9]{2}\)?[ -][0-9]{3}-[0-9]{4}$",
}
CONTEXT_CHARS = 24
PRIOR_SHARE = 0.5
SCAN_BLOCK = 64


def _before_block(values: Column, start: Column, combine) -> Column:
    step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def before_each(values: Column, combine=lambda a, x: a + x, levels: int = 2) -> Column:
    """For each of some ints (at least 0) the sum, or other ``combine``, of those
    before it.  An array grows by copying, so only blocks of ``SCAN_BLOCK`` are
    grown, and the blocks' own totals alike: the work is linear in the values."""
    zero = F.lit(0)
    if not levels:
        return _before_block(values, zero, combine)

    def blocks_of(values):
        blocks = F.transform(F.sequence(zero, F.floor((F.size(values) - 1) / SCAN_BLOCK).cast("int")),
                             lambda j: F.slice(values, j * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)))
        return let(blocks, lambda bs: let(
            before_each(F.transform(bs, lambda b: F.aggregate(b, zero, combine)), combine, levels - 1),
            lambda starts: F.flatten(F.transform(bs, lambda b, j: _before_block(b, F.get(starts, j), combine)))))

    return F.when(F.size(values) > 0, let(values, blocks_of)).otherwise(F.array().cast("array<int>"))


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def matches_with_positions(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start,end,value,before,after>> of the leftmost
    non-overlapping matches; before and after are the neighbouring pieces'
    ends, at most ``CONTEXT_CHARS`` long."""
    kind = ("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    empty = F.array().cast(kind)

    def located(gaps: Column, found: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(found) - 1)
        lengths = F.transform(at, lambda i: F.length(F.get(gaps, i)) + F.length(F.get(found, i)))

        def spans(begins: Column) -> Column:
            def span(i):
                gap, value = F.get(gaps, i), F.get(found, i)
                start = F.get(begins, i) + F.length(gap)
                return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
                                F.right(gap, F.lit(CONTEXT_CHARS)).alias("before"),
                                F.left(F.coalesce(F.get(gaps, i + 1), F.lit("")), F.lit(CONTEXT_CHARS)).alias("after"))
            return F.transform(at, span).cast(kind)

        return F.when(F.size(found) > 0, let(before_each(lengths), spans)).otherwise(empty)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.when(gate, let_all([gaps, found], located)).otherwise(empty)


def outside(found: Column, spans: Column) -> Column:
    """Those of ``found`` (with start and end) that overlap none of ``spans``: by
    binary search among the spans' starts, for the farthest end up to there."""
    def search(ordered: Column) -> Column:
        starts = F.transform(ordered, lambda s: s["start"])
        before = before_each(F.transform(ordered, lambda s: s["end"]), _larger)
        reach = lambda b: F.transform(ordered, lambda s, i: F.greatest(s["end"], F.get(b, i)))
        return let_all([starts, let(before, reach)], lambda first, far: F.filter(found, lambda m: clear(m, first, far)))

    def clear(m: Column, first: Column, far: Column) -> Column:
        def step(acc, _):
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            below = (acc["lo"] < acc["hi"]) & (F.get(first, mid) < m["end"])
            return F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"),
                            F.when(below | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

        steps = F.sequence(F.lit(0), F.length(F.bin(F.size(first))))
        zero = F.struct(F.lit(0).alias("lo"), F.size(first).alias("hi"))
        begun = F.aggregate(steps, zero, step, lambda acc: acc["lo"])  # spans that start before m ends
        return let(begun, lambda n: (n == 0) | (F.get(far, n - 1) <= m["start"]))

    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.when((F.size(found) == 0) | (F.size(spans) == 0), found).otherwise(let(ordered, search))


def luhn_ok(digits: Column) -> Column:
    """The Luhn checksum of a digit string."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, 1, 1) if isinstance(i, int) else F.substr(digits, n - i, F.lit(1))
        v = d.cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":  # parts at most 255, whatever their leading zeros
        parts = F.split(value, r"\.", -1)
        return F.forall(parts, lambda p: let(
            F.regexp_replace(p, "^0+", ""),
            lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(16, 19), luhn_ok(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of one kind, by start."""
    found = matches_with_positions(text, BASE_PATTERNS[kind], BASE_GATES[kind](text))
    good = F.filter(found, lambda m: _valid(kind, m["value"]))
    return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"),
                                                m["end"].alias("end")))


def _labelers(kind: str, m: Column) -> dict[str, Column]:
    """The votes on a candidate of ``kind``: +1, -1 or 0."""
    value, before, after = m["value"], m["before"], m["after"]
    cue = F.lower(F.regexp_extract(before, r"([A-Za-z_]+)[\x20\x09:=\"'(]*$", 1))
    length = F.length(value)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    if kind == "secret":
        return {
            "regex_shape": vote(value.rlike(SHAPES[kind]), ~value.rlike("[A-Za-z]") | value.rlike("^[a-z]+[-_/][a-z]+")),
            "gazetteer_cue": vote(cue.isin(CUE_WORDS[kind]), F.lit(False)),
            "context_assign": vote(before.rlike(r"[=:][\x20\x09]*[\"']?$"), before.rlike(r"[A-Za-z0-9],?[\x20]$") & ~value.rlike(SHAPES[kind])),
            "context_edge": vote(after.rlike(r"^[\"']"), after.rlike(r"^[@.]")),
            "regex_mix": vote((digits * 5 >= length) & (digits < length), digits * 10 < length),
        }
    return {
        "regex_shape": vote(value.rlike(SHAPES[kind]), value.rlike(r"^\(?[01]")),
        "gazetteer_cue": vote(cue.isin(CUE_WORDS[kind]), F.lit(False)),
        "context_assign": vote(before.rlike(r"[=:][\x20\x09]*$"), F.lit(False)),
        "context_edge": vote(after.rlike(r"^[\x20\n.,;]") | (after == ""), after.rlike(r"^[A-Za-z0-9]")),
        "regex_mix": vote(value.rlike(r"^\([0-9]{3}\)"), F.lit(False)),
    }


LABELERS = ("regex_shape", "gazetteer_cue", "context_assign", "context_edge", "regex_mix")
FEATURES = ("f_len", "f_digits", "f_case", "f_quote", "f_assign", "f_cue", "f_shape")


def _features(kind: str, m: Column) -> dict[str, Column]:
    """Small integer features of a candidate, for the span classifier."""
    value, before, after = m["value"], m["before"], m["after"]
    length = F.length(value)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    cue = F.lower(F.regexp_extract(before, r"([A-Za-z_]+)[\x20\x09:=\"'(]*$", 1))
    return {
        "f_len": F.when(length < 16, 0).when(length < 24, 1).when(length < 40, 2).otherwise(3),
        "f_digits": F.when(digits * 10 < length, 0).when(digits * 4 < length, 1).when(digits < length, 2).otherwise(3),
        "f_case": F.when(value.rlike("[a-z]") & value.rlike("[A-Z]"), 2).when(value.rlike("[A-Z]"), 1).otherwise(0),
        "f_quote": F.when(before.rlike("[\"']$") & after.rlike("^[\"']"), 1).otherwise(0),
        "f_assign": F.when(before.rlike(r"[=:][\x20\x09]*[\"']?$"), 1).otherwise(0),
        "f_cue": F.when(cue.isin(CUE_WORDS[kind]), 1).otherwise(0),
        "f_shape": F.when(value.rlike(SHAPES[kind]), 1).otherwise(0),
    }


FEATURE_VALUES = {"f_len": 4, "f_digits": 4, "f_case": 3, "f_quote": 2, "f_assign": 2, "f_cue": 2, "f_shape": 2}


def candidate_spans(text: Column, kind: str, base: Column) -> Column:
    """Candidates of a learned kind that overlap no base span, with their
    votes and features."""
    found = matches_with_positions(text, CANDIDATES[kind], CANDIDATE_GATES[kind](text))
    free = let(found, lambda f: outside(f, base))
    return F.transform(free, lambda m: F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
        *[v.cast("int").alias(n) for n, v in _labelers(kind, m).items()],
        *[v.cast("int").alias(n) for n, v in _features(kind, m).items()]))


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (spans by kind and start) and ``_cand``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    based = docs.withColumn("_base", F.concat(*[base_spans(text, k) for k in BASE_KINDS]))
    return based.withColumn("_cand", F.concat(
        *[candidate_spans(text, k, F.col("_base")) for k in CANDIDATES]))


@dataclass
class SpanModel:
    """Labeler reliabilities and classifier weights per kind."""

    priors: dict[str, float]
    reliability: dict[str, dict[str, dict[int, tuple[float, float]]]]
    weights: dict[str, dict[tuple[str, int], float]]
    bias: dict[str, float]

    def logit(self, c: Column) -> Column:
        out = F.lit(-1e9)
        for kind, ws in self.weights.items():
            z = F.lit(self.bias[kind])
            for f in FEATURES:
                z = z + F.element_at(F.array(*[F.lit(ws[(f, v)]) for v in range(FEATURE_VALUES[f])]), c[f] + 1)
            out = F.when(c["kind"] == kind, z).otherwise(out)
        return out


def _em(rows: list[tuple[tuple[int, ...], int]], rounds: int = 40):
    """Two-class EM over (votes, count) rows: prior, P(vote | class) per
    labeler, posterior per row.

    Starts from the votes: a known shape or the votes' sum.  Each table has
    Dirichlet pseudo-counts, ``PRIOR_SHARE`` of the candidates, that say +1
    speaks for the class and -1 against it (most strongly for known shapes);
    they keep the classes from turning into a split by context alone."""
    shape = LABELERS.index("regex_shape")
    q = [1 / (1 + math.exp(-3.0 * v[shape] - sum(v))) for v, _ in rows]
    total = sum(n for _, n in rows) or 1
    base = 1 + PRIOR_SHARE * total
    prior, tables = 0.5, []
    for _ in range(rounds):
        pos = sum(n * p for (_, n), p in zip(rows, q))
        prior = min(max(pos / total, 0.01), 0.99)
        tables = []
        for j in range(len(LABELERS)):
            t = {}
            for vote in (-1, 0, 1):
                strong = 0.9 if j == shape else 0.6
                a, b = {1: (strong, 0.02), -1: (0.02, strong), 0: (0.98 - strong, 0.98 - strong)}[vote]
                up = a * base + sum(n * p for (v, n), p in zip(rows, q) if v[j] == vote)
                dn = b * base + sum(n * (1 - p) for (v, n), p in zip(rows, q) if v[j] == vote)
                t[vote] = (up / (pos + base), dn / (total - pos + base))
            tables.append(t)
        new = []
        for v, _ in rows:
            z = math.log(prior / (1 - prior)) + sum(math.log(tables[j][v[j]][0] / tables[j][v[j]][1]) for j in range(len(v)))
            new.append(1 / (1 + math.exp(-max(min(z, 30), -30))))
        q = new
    return prior, tables, q


def _fit_logistic(rows, steps: int = 300, rate: float = 0.5, decay: float = 1e-3):
    """Full-batch gradient descent on one-hot features with soft labels."""
    w = {(f, v): 0.0 for f in FEATURES for v in range(FEATURE_VALUES[f])}
    bias, total = 0.0, sum(n for _, n, _ in rows) or 1
    for _ in range(steps):
        grad, gb = dict.fromkeys(w, 0.0), 0.0
        for feats, n, label in rows:
            z = bias + sum(w[(f, v)] for f, v in zip(FEATURES, feats))
            e = n / total * (1 / (1 + math.exp(-max(min(z, 30), -30))) - label)
            gb += e
            for f, v in zip(FEATURES, feats):
                grad[(f, v)] += e
        bias -= rate * gb
        for k in w:
            w[k] -= rate * (grad[k] + decay * w[k])
    return w, bias


def fit_span_model(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Count candidates by pattern over all texts, then fit on the counts.

    What reaches the driver is one row for each vote and feature pattern that
    occurs: at most 3^5 * 768 a kind, in practice some dozens."""
    names = [*LABELERS, *FEATURES]
    counted = (with_candidates(docs.select(F.col(f"`{text_col}`").alias("text")))
               .select(F.explode_outer("_cand").alias("c")).where(F.col("c").isNotNull())
               .groupBy("c.kind", *[F.col(f"c.{n}").alias(n) for n in names]).count())
    rows = sorted(tuple(r) for r in counted.collect())
    model = SpanModel({}, {}, {}, {})
    k = len(LABELERS)
    for kind in CANDIDATES:
        mine = [(r[1:1 + k], r[1 + k:1 + k + len(FEATURES)], r[-1]) for r in rows if r[0] == kind]
        prior, tables, q = _em([(v, n) for v, _, n in mine])
        model.priors[kind] = prior
        model.reliability[kind] = dict(zip(LABELERS, tables))
        model.weights[kind], model.bias[kind] = _fit_logistic([(f, n, p) for (_, f, n), p in zip(mine, q)])
    return model


def find_pii(docs: DataFrame, model: SpanModel | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (kind, start, end)
    by kind and start, base spans and those the classifier adds."""
    model = model or fit_span_model(docs, text_col)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("base_spans", "spans", "_base", "_cand")]
    found = with_candidates(docs.select(*keep), text_col)
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    added = F.transform(F.filter(F.col("_cand"), lambda c: model.logit(c) >= 0), plain)
    return found.select(*keep, F.col("_base").cast(NO_SPANS).alias("base_spans"),
                        F.concat(F.col("_base"), added).cast(NO_SPANS).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(text: Column, spans: Column, origin: Column, level: int) -> Column:
    """``text``, which begins at code point ``origin``, up to the reach of ``spans``
    with each clear span as its kind.  Cutting a string reads it from its
    beginning, so spans are cut from blocks of the text, and blocks from larger
    ones."""
    if not level:
        piece = lambda s: F.when(s["start"] >= s["before"], F.concat(
            F.substr(text, s["before"] - origin + 1, s["start"] - s["before"]),
            F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))
        return F.array_join(F.transform(spans, piece), "")
    wide = SCAN_BLOCK ** level
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / wide).cast("int")),
                         lambda j: F.slice(spans, j * wide + 1, F.lit(wide)))

    def part(block: Column) -> Column:
        ends = [F.get(block, F.lit(0))["before"], F.element_at(block, -1)["reach"]]
        return let_all(ends, lambda lo, hi: let(
            F.substr(text, lo - origin + 1, hi - lo), lambda t: _cut(t, block, lo, level - 1)))

    return F.array_join(F.transform(blocks, part), "")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets.
    Overlapping spans are replaced together, under the first one's kind."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(body: Column, sorted_spans: Column) -> Column:
        # how far the spans before each one, and it with them, reach
        before = before_each(F.transform(sorted_spans, lambda s: s["end"]), _larger)
        placed = lambda b: F.transform(sorted_spans, lambda s, i: F.struct(
            F.get(b, i).alias("before"), s["start"].alias("start"), F.greatest(F.get(b, i), s["end"]).alias("reach"),
            s["kind"].alias("kind")))
        return let(let(before, placed), lambda ss: F.concat(
            _cut(body, ss, F.lit(0), 2), F.substr(body, F.element_at(ss, -1)["reach"] + 1, F.length(body))))

    return F.when(F.size(spans) > 0, let_all([F.coalesce(text, F.lit("")), ordered], cut)).otherwise(text)


def digest_columns(found: DataFrame) -> DataFrame:
    """The registered query's columns."""
    count = lambda k: F.size(F.filter(F.col("base_spans"), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS],
                        F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))
