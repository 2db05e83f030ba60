"""Personal data by weak supervision (operator 8); DataFrame functions only.

Spans: the base patterns (e-mail, IP address, card, phone) and wider candidate
patterns. Regular expressions run in the JVM; places come from the lengths of
what they split off. Every span gets votes (1, 0 or -1) of four labelers: its
form, a gazetteer, the words before it, its borders.

One pass over all documents finds the candidates; what it found is cut into the
checkpoint folder. The spans are counted by kind, votes and shape; that table has at
most as many rows as there are combinations (some 20,000), whatever the input. On
these counts the driver runs expectation-maximisation: it estimates
each labeler's reliabilities (how it votes on true and on false spans) and each
kind's share of true spans, and then trains the span classifier, a logistic
regression on kind, votes and shape, against the resulting posteriors. Its weights
are then applied to the candidates as literals. Base spans stay whatever it says; others
stay from ``LEAST`` on, if they don't overlap a base span.

The patterns of the contract are written so that Java neither recurses nor goes
back: possessive where what follows can't match inside, and starting only where a
run starts or the last match ended; the matches are the same.

A text may have any length and any number of spans: running sums and maxima are
taken by blocks of ``BLOCK`` spans, and pieces of a text are cut out of blocks of
``PIECE`` characters, so no step takes the square of either.

Defined results: null and empty texts have no spans (the digest of no bytes);
repeated rows give repeated rows; a null doc_id is carried along; an empty table
gives an empty table; other columns are ignored (and kept by ``redact``).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyplan.llm.common import cut

#: Kinds in the order of the digest; the first four have base patterns.
KINDS = ["email", "ip", "card", "phone", "secret", "iban", "ssn", "name"]
#: The base patterns, as written out in the module's comment.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Common given names of the corpus's four languages.
FORENAMES = "|".join(
    """
    Anna Maria John James Mary Peter Paul Hans Klaus Ursula Jean Pierre Marie Claire Luis Carlos Carmen Ana David Sarah Laura Thomas Michael Julia
    Robert William Richard Joseph Charles Daniel Matthew Anthony Mark Donald Steven Andrew Kenneth Joshua Kevin Brian George Edward Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Lisa Nancy Betty Margaret Sandra Ashley Emily Emma Olivia
    Stefan Andreas Markus Martin Wolfgang Jürgen Dieter Uwe Sabine Petra Monika Heike Katrin Lena Leon Lukas Jonas Felix Sophie Hannah
    François Michel Philippe Alain Nicolas Laurent Isabelle Nathalie Sylvie Camille Chloé Léa Hugo Louis Antoine
    José Antonio Manuel Francisco Juan Javier Miguel Pedro Lucía Isabel Dolores Pilar Teresa Marta Elena Sofía Pablo Diego Alejandro
    """.split()
)
TITLES = r"Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
#: What stands before a secret's value: a word for it, also within a longer name (AWS_SECRET, client_secret_2, "apiKey"), and a sign.
WORD = r"(?i:token|secret|passwo?r?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth(?:orization)?+)"
SECRET = WORD + r"(?:s|[0-9]{1,3}+|[_-][A-Za-z0-9_-]{0,30}+|[A-Z][A-Za-z0-9]{0,20}+)?+[\"']?[ ]{0,2}[=:]"
VALUE = r"[A-Za-z0-9_+/!#$%^&*@-]{6,}+(?:[.~][A-Za-z0-9_+/-]++)*+=*+"
#: Secrets that are known by how they start, whatever stands before them.
STARTS = r"(?:AKIA|ASIA|AROA|AIDA)(?=[A-Z0-9]{16}\b)|gh[pousr]_(?=[A-Za-z0-9]{20})|sk-(?=[A-Za-z0-9_-]{20})|xox[abprs]-(?=[A-Za-z0-9-]{10})|AIza(?=[A-Za-z0-9_-]{35})|eyJ(?=[A-Za-z0-9_-]{10})|(?i:bearer|basic)[ ](?=[A-Za-z._~+/-]{0,99}[0-9])(?=[A-Za-z0-9._~+/-]{16})"
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s:,.]*+(?:-[A-Za-z0-9+/=\s:,.]++){0,9}+(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?+"
#: Candidates beside the base patterns.
WIDE = {
    "secret": SECRET + r"[ ]{0,2}[\"']?(?:(?i:bearer|basic|token)[ ]{1,2})?" + VALUE + rf"[\"']?|\b(?:{STARTS})[A-Za-z0-9._~+/-]++=*+|{PEM}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+?[0-9]{0,3} ?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,4})(?![0-9])",
    "name": rf"\b(?:{TITLES})\.? (?:{FORENAMES}|\p{{Lu}}\p{{Ll}}+)(?: \p{{Lu}}\p{{Ll}}+)?",
}
WIDE_ALL = "|".join(f"(?:{p})" for p in WIDE.values())
#: Words before a span that speak for it or against it.
FOR = {
    "email": "mail|contact|write|address|kontakt|correo|courriel", "ip": "ip|host|server|addr|client", "card": "card|visa|credit|karte|carte|tarjeta|pay", "phone": "phone|tel|call|mobile|fax|contact|telefon|móvil",
    "secret": "token|secret|key|auth|pass", "iban": "iban|account|konto|compte|cuenta", "ssn": "ssn|social|security", "name": "name|by|author|from|von|par|por",
}
AGAINST = r"version|isbn|issn|section|figure|page|chapter|license|licence|build|release|order no|sku"
DOMAINS = r"\.(?:com|net|org|edu|gov|io|de|fr|es|uk|eu|info|co|us)$"
#: Posterior from which on a candidate is a span.
LEAST = 0.5
#: Where expectation-maximisation starts: a vote is right, a span is true; and how many votes that counts for.
FIRST_GUESS, FIRST_SHARE, PRIOR = 0.8, 0.7, 20.0
#: Spans, and characters, that are taken together.
BLOCK, PIECE = 128, 1024
SPAN = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
LABELERS = ["form", "gazetteer", "context", "border"]
FEATURES = ["kind", *LABELERS, "length", "digits"]


def _bind(value: Column, f) -> Column:
    """f(value) with value computed once; f gives an array."""
    return F.flatten(F.transform(F.array(value), f))


def before_each(parts: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """For each part what join makes of 0 and the values (int) of the parts before it."""

    def block(of: Column, b: Column) -> Column:
        return F.slice(of, b * BLOCK + 1, F.lit(BLOCK))

    def add(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["at"], value(x)).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def told(z: Column) -> Column:
        def of_block(_: Column, b: Column) -> Column:
            start = F.aggregate(F.slice(z["totals"], F.lit(1), b), F.lit(0), lambda a, x: join(a, x).cast("int"))
            return F.aggregate(block(z["parts"], b), F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])

        return F.flatten(F.transform(z["totals"], of_block))

    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
    totals = F.transform(blocks, lambda b: F.aggregate(block(parts, b), F.lit(0), lambda a, x: join(a, value(x)).cast("int")))
    return F.when(F.size(parts) > 0, _bind(F.struct(parts.alias("parts"), totals.alias("totals")), told)).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches with places in code points, the 40 characters before and the one after."""

    def parts(z: Column) -> Column:
        return F.transform(z["m"], lambda m, i: F.struct(
            m.alias("m"), F.length(F.get(z["p"], i)).alias("lead"), F.length(m).alias("n"), F.right(F.get(z["p"], i), F.lit(40)).alias("before"), F.left(F.get(z["p"], i + 1), F.lit(1)).alias("after"),
        ))

    def placed(z: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            s = F.get(z["at"], i) + x["lead"]
            return F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))

        return F.transform(z["x"], one)

    cut_up = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    with_places = lambda x: F.struct(x.alias("x"), before_each(x, lambda y: y["lead"] + y["n"], Column.__add__).alias("at"))
    bound = F.transform(F.transform(F.array(cut_up), parts), with_places)
    return F.coalesce(F.when(gate, F.flatten(F.transform(bound, placed))), F.array().cast(SPAN))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does the digit string pass Luhn's check?"""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The base check of a match."""
    n = F.length(digits_of(m))
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits_of(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _by_kind(kind: Column, of: dict[str, Column], other: Column) -> Column:
    out = other
    for k, c in of.items():
        out = F.when(kind == k, c).otherwise(out)
    return out


def voted(x: Column, kind: Column, base: Column) -> Column:
    """The span with its votes and shape."""
    m, n = x["m"], F.length(digits_of(x["m"]))
    sign = lambda c: F.when(c, 1).otherwise(-1)
    strict = {"card": n == 16, "phone": n.between(9, 15), "secret": (F.length(m) >= 24) | m.rlike("[=:][^=:]*[0-9]"), "iban": F.length(m) >= 18, "ip": m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")}
    form = F.when(base, 1).otherwise(sign(_by_kind(kind, strict, F.lit(True))))
    known = {
        "email": sign(m.rlike(f"(?i){DOMAINS}")), "ip": F.when(m.rlike(r"^(?:0|127|255)\."), -1).otherwise(0), "card": F.when(m.rlike("^[3-6]"), 1).otherwise(0), "phone": F.when(m.rlike(r"^\+(?:1|33|34|44|49)[^0-9]"), 1).otherwise(0),
        "secret": F.when(m.rlike(f"^(?:{WORD}|{STARTS}|-----BEGIN)"), 1).otherwise(0), "iban": sign(m.rlike("^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|LU)")), "name": F.when(m.rlike(rf"\b(?:{FORENAMES})\b"), 1).otherwise(0),
    }
    speaks = _by_kind(kind, {k: x["before"].rlike(rf"(?i)\b(?:{w})") for k, w in FOR.items()}, F.lit(False))
    context = F.when(x["before"].rlike(rf"(?i)\b(?:{AGAINST})\b"), -1).when(speaks, 1).otherwise(0)
    border = sign(~x["after"].rlike(r"[\p{L}\p{N}]") & ~x["before"].rlike(r"[\p{L}\p{N}]$"))
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"), kind.alias("kind"), base.alias("base"), form.alias("form"), _by_kind(kind, known, F.lit(0)).alias("gazetteer"), context.alias("context"), border.alias("border"),
        F.least(F.lit(3), F.floor(F.length(m) / 12)).cast("int").alias("length"), F.floor(F.least(F.lit(0.99), n / F.length(m)) * 4).cast("int").alias("digits"),
    )


def candidates(text: Column) -> Column:
    """Base spans, and wide candidates that don't overlap one, of a text, in no order."""
    text = F.coalesce(text, F.lit(""))
    numeric = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": numeric, "card": numeric, "phone": F.contains(text, F.lit("+"))}

    def base_spans(kind: str) -> Column:
        good = F.filter(spans_of(text, BASE[kind], gates[kind]), lambda x: passes(kind, x["m"]))
        return F.transform(good, lambda x: voted(x, F.lit(kind), F.lit(True)))

    base = F.concat(*map(base_spans, BASE))
    wide = spans_of(text, WIDE_ALL, numeric | text.rlike(rf"\b(?:{TITLES})\b") | text.rlike(rf"{SECRET}|\b(?:{STARTS})|-----BEGIN "))

    def kind_of(m: Column) -> Column:
        out = F.lit(next(iter(WIDE)))
        for k, p in reversed(WIDE.items()):
            out = F.when(m.rlike(f"^(?:{p})$"), F.lit(k)).otherwise(out)
        return out

    def joined(z: Column) -> Column:
        """Base spans, and the wide ones that overlap none: a sweep over both by start, base spans first."""
        base_ends = F.transform(z["b"], lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("o"), x["e"].alias("e"), F.lit(0).alias("i")))
        wide_ends = F.transform(z["w"], lambda x, i: F.struct(x["s"].alias("s"), F.lit(1).alias("o"), x["e"].alias("e"), i.alias("i")))

        def free(y: Column) -> Column:
            def alone(x: Column, j: Column) -> Column:
                after = F.get(y["x"], j + 1)  # wide spans don't overlap, so a base span that starts inside comes next
                return (x["o"] == 1) & (F.get(y["ends"], j) <= x["s"]) & ~F.coalesce((after["o"] == 0) & (after["s"] < x["e"]), F.lit(False))

            return F.transform(F.filter(y["x"], alone), lambda x: F.get(z["w"], x["i"]))

        swept = _bind(F.array_sort(F.concat(base_ends, wide_ends)), lambda x: F.array(F.struct(x.alias("x"), before_each(x, lambda y: F.when(y["o"] == 0, y["e"]).otherwise(0), F.greatest).alias("ends"))))
        kept = F.flatten(F.transform(swept, free))
        return F.when(F.size(z["w"]) == 0, z["b"]).otherwise(F.concat(z["b"], F.transform(kept, lambda x: voted(x, kind_of(x["m"]), F.lit(False)))))

    return _bind(F.struct(base.alias("b"), wide.alias("w")), joined)


class Model:
    """What the votes say: reliabilities, and the classifier's weights by feature value."""

    def __init__(self, reliabilities: dict[str, dict[int, tuple[float, float]]], weights: dict[tuple[str, object], float], bias: float):
        self.reliabilities, self.weights, self.bias = reliabilities, weights, bias

    def logit(self, x: Column) -> Column:
        """The classifier of a span as a column."""
        total = F.lit(float(self.bias))
        for f in FEATURES:
            of = {v: w for (g, v), w in sorted(self.weights.items(), key=str) if g == f}
            if of:
                pairs = [F.lit(y) for v, w in of.items() for y in (str(v), float(round(w, 9)))]
                total = total + F.coalesce(F.try_element_at(F.create_map(*pairs), x[f].cast("string")), F.lit(0.0))
        return total

    def p(self, row: dict) -> float:
        return 1 / (1 + math.exp(-self.bias - sum(self.weights.get((f, row[f]), 0.0) for f in FEATURES)))


def maximise(rows: list[dict], turns: int = 50) -> tuple[dict, list[float]]:
    """Expectation-maximisation over counted votes (kind, labelers, n): each labeler's reliability (how often its votes are right; abstaining says nothing), and the posterior of each row.

    Reliabilities come back as vote -> (P(vote | true span), P(vote | false span)).
    """
    right = dict.fromkeys(LABELERS, FIRST_GUESS)
    share = defaultdict(lambda: FIRST_SHARE)
    posterior = [FIRST_SHARE] * len(rows)
    for _ in range(turns):
        for i, r in enumerate(rows):
            yes, no = share[r["kind"]], 1 - share[r["kind"]]
            for lab in LABELERS:
                if r[lab]:
                    yes, no = (yes * right[lab], no * (1 - right[lab])) if r[lab] > 0 else (yes * (1 - right[lab]), no * right[lab])
            posterior[i] = yes / (yes + no)
        for lab in LABELERS:
            good, votes = PRIOR * FIRST_GUESS, PRIOR
            for r, p in zip(rows, posterior, strict=True):
                if r[lab]:
                    good += r["n"] * (p if r[lab] > 0 else 1 - p)
                    votes += r["n"]
            right[lab] = min(0.999, max(0.5, good / votes))
        yes_of, all_of = defaultdict(lambda: PRIOR * FIRST_SHARE), defaultdict(lambda: PRIOR)
        for r, p in zip(rows, posterior, strict=True):
            yes_of[r["kind"]] += r["n"] * p
            all_of[r["kind"]] += r["n"]
        share = defaultdict(lambda: FIRST_SHARE, {k: min(0.99, max(0.01, yes_of[k] / all_of[k])) for k in all_of})
    return {lab: {1: (a, 1 - a), 0: (1.0, 1.0), -1: (1 - a, a)} for lab, a in right.items()}, posterior


def fit(rows: list[dict], turns: int = 200) -> Model:
    """Reliabilities by expectation-maximisation, then the span classifier on the posteriors; rows are counts, in any order."""
    rows = sorted(rows, key=lambda r: str([r[f] for f in FEATURES]))
    if not rows:
        return Model({}, {}, 0.0)
    rates, posterior = maximise(rows)
    weights: dict[tuple[str, object], float] = defaultdict(float)
    total = sum(r["n"] for r in rows)
    of_value: dict[tuple[str, object], float] = defaultdict(float)
    for r in rows:
        for f in FEATURES:
            of_value[f, r[f]] += r["n"]
    model = Model(rates, weights, 0.0)
    for _ in range(turns):  # each value's gradient over its own weight: steps that fit rare values, too
        slope: dict[tuple[str, object], float] = defaultdict(float)
        bias = 0.0
        for r, p in zip(rows, posterior, strict=True):
            miss = r["n"] * (p - model.p(r))
            bias += miss
            for f in FEATURES:
                slope[f, r[f]] += miss
        model.bias += 0.5 * bias / total
        for k, g in slope.items():
            weights[k] += 0.5 * (g - 0.01 * weights[k]) / (of_value[k] + 1)
    return model


def found(docs: DataFrame, columns: list[Column], text: str, name: str) -> DataFrame:
    """columns, and as ``name`` the array of all candidates of the whole text; cut."""
    return cut(docs.select(*columns, F.explode(F.array(candidates(F.col(f"`{text}`")))).alias(name)))


def train(spans: DataFrame, name: str) -> Model:
    """Count the candidates of all documents by kind, votes and shape, and fit."""
    counts = spans.select(F.explode(name).alias("x")).select("x.*").groupBy(*FEATURES).agg(F.count("*").alias("n"))
    return fit([r.asDict() for r in counts.collect()])  # at most 8 * 3 ** 4 * 4 * 4 rows


def decided(spans: DataFrame, name: str) -> DataFrame:
    """The rows, with the candidates that stay in ``name``, by start and kind."""
    model = train(spans, name)
    order = F.create_map(*[F.lit(y) for i, k in enumerate(KINDS) for y in (k, i)])
    keep = lambda x: x["base"] | (model.logit(x) >= math.log(LEAST / (1 - LEAST)))
    kept = F.transform(F.filter(name, keep), lambda x: F.struct(x["s"].alias("s"), order[x["kind"]].alias("o"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base")))
    others = [F.col(f"`{c}`") for c in spans.columns if c != name]
    return spans.select(*others, F.explode(F.array(F.array_sort(kept))).alias(name))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text."""
    out = decided(found(docs, [F.col(f"`{key}`").alias("k")], text, "x"), "x")
    base = F.filter("x", lambda s: s["base"])
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("x", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return out.select(F.col("k").alias(key), *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("x")).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with its spans, sorted by start, replaced by their kinds; of those that overlap the first."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(z: Column, a: Column, b: Column) -> Column:
        low, high = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        return F.substring(F.array_join(F.slice(z["pieces"], low + 1, high - low + 1), ""), a - low * PIECE + 1, b - a)

    def told(z: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            at = F.get(z["ends"], i)
            return F.when(x["s"] >= at, F.concat(between(z, at, x["s"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise("")

        last = F.array_max(F.transform(z["x"], lambda x: x["e"]))
        return F.concat(F.transform(z["x"], one), F.array(between(z, last, z["n"])))

    parts = F.struct(spans.alias("x"), before_each(spans, lambda x: x["e"], F.greatest).alias("ends"), pieces.alias("pieces"), F.length(text).alias("n"))
    return F.array_join(_bind(parts, told), "")


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets; the column ``length`` is kept true."""
    name = "__spans"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    out = decided(found(docs, [F.col(f"`{c}`") for c in docs.columns], text, name), name)
    new = out.withColumn(text, F.when(F.size(name) > 0, replaced(F.col(text), F.col(name))).otherwise(F.col(text)))
    if length in docs.columns:
        new = new.withColumn(length, F.when(F.size(name) > 0, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])
