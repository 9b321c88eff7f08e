"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.session import materialize

#: Kinds in the order of the results. Candidates of the first four follow fixed patterns; ``secret`` is a long run of letters and digits.
KINDS = ("email", "ip", "card", "phone", "secret")

# The patterns of the four base kinds, written so that no group is entered again after a match (possessive), which bounds time and stack on long texts.
_ADDRESS = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_ADDRESS})|\G){_ADDRESS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{16,}+",
}

# What the gazetteer labeler knows: top-level domains, first digits of card issuers, country codes, beginnings of keys.
DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|us|ca"
ISSUERS = "4|5[1-5]|34|37|6011|65"
COUNTRIES = "1|33|34|39|44|49|41|43|52|61|81|86|91"
KEY_HEADS = "sk_|pk_|ghp_|xox|AKIA"
# Words before a span that speak for each kind, and words that speak against all of them.
CUES = {
    "email": "mail|contact|write to|@", "ip": r"\bip\b|host|server|address|ping", "card": "card|visa|credit|karte|tarjeta|carte", "phone": "phone|tel|call|fax|mobil",
    "secret": r"passw|pwd|secret|token|api.?key|\bkey\b|credential",
}
AGAINST = "version|isbn|build|commit|sha|md5|checksum|order|invoice|no[.]"

_MARK = "\ue000"
_SPAN = "struct<start:int,stop:int,text:string,before:string>"


def _matches(marked: Column) -> Column:
    """Spans of a text in which every match stands between two marks.

    Pieces are taken in runs of 256, so that a text with very many matches costs no more per match.
    """
    empty = F.array().cast(f"array<{_SPAN}>")

    def step(s: Column, part: Column) -> Column:
        stop = s["at"] + F.length(part)
        span = F.struct(s["at"].alias("start"), stop.alias("stop"), part.alias("text"), s["last"].alias("before"))
        return F.struct(stop.alias("at"), (~s["inside"]).alias("inside"), F.right(part, F.lit(24)).alias("last"), F.when(s["inside"], F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    def run(s: Column, parts: Column) -> Column:
        fresh = F.struct(s["at"].alias("at"), s["inside"].alias("inside"), s["last"].alias("last"), empty.alias("out"))
        join = lambda r: F.struct(r["at"].alias("at"), r["inside"].alias("inside"), r["last"].alias("last"), F.concat(s["out"], F.array(r["out"])).alias("out"))
        return F.aggregate(parts, fresh, step, join)

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.lit("").alias("last"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
    pieces = F.split(marked, _MARK, -1)
    runs = F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(256)), lambda k: F.slice(p, k, F.lit(256))))
    return F.flatten(F.aggregate(F.element_at(runs, 1), start, run, lambda s: s["out"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds; every second digit from the right is doubled."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        byte = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return text.rlike(rf"^{byte}(?:\.{byte}){{3}}$")
    n = F.length(_digits(text))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(False)


def _votes(kind: str, span: Column, valid: Column) -> list[Column]:
    """1 for personal data, -1 against, 0 for no opinion: by format, by gazetteer, by context."""
    text, before = span["text"], F.lower(span["before"])
    if kind == "secret":
        form = F.when(text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 1).when(text.rlike("[A-Za-z]{12,}"), -1).otherwise(0)
    else:
        form = F.when(valid, 1).otherwise(-1)
    known = {
        "email": F.when(text.rlike(rf"(?i)\.(?:{DOMAINS})$"), 1).otherwise(-1), "ip": F.when(text.rlike(r"^(?:0|255)\."), -1).otherwise(1),
        "card": F.when(_digits(text).rlike(f"^(?:{ISSUERS})") & F.length(_digits(text)).between(13, 19), 1).otherwise(-1),
        "phone": F.when(text.rlike(rf"^\+(?:{COUNTRIES})(?![0-9]{{11}})"), 1).otherwise(0), "secret": F.when(text.rlike(f"^(?:{KEY_HEADS})"), 1).otherwise(0),
    }[kind]
    context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(-1 if kind == "secret" else 0)
    return [form.cast("int"), known.cast("int"), context.cast("int")]


def _features(kind: str, span: Column, valid: Column) -> list[Column]:
    """What the classifier sees of a span: its length, share of digits, signs, whether it passes its kind's check, the sign before it and whether a cue stands before it."""
    text, n = span["text"], F.length(span["text"])
    share = F.floor(4 * F.length(_digits(text)) / F.greatest(n, F.lit(1)))
    before = F.right(span["before"], F.lit(1))
    side = F.when(span["before"] == "", "start").when(before.rlike(r"\s"), "blank").when(before.rlike(r"[\"'=:]"), "assign").when(before.rlike(r"[.,;()\[\]-]"), "sign").otherwise("other")
    named = {
        "length": F.least(F.floor(n / 4), F.lit(12)).cast("string"), "digits": share.cast("string"), "signs": text.rlike("[^A-Za-z0-9]").cast("string"), "before": side, "check": valid.cast("string"),
        "cue": F.lower(span["before"]).rlike(CUES[kind]).cast("string"),
    }
    return [F.concat(F.lit(f"{kind}/{k}="), v) for k, v in named.items()]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): every candidate span of every row with kind (its place in KINDS), start, stop, valid, votes and features."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK, "\ufffd")
    rows = docs.select(F.col(id_col).alias("id"), F.when(text.rlike("[0-9@]"), text).alias("text"))
    text = F.col("text")
    hot = {k: F.lit(True) for k in KINDS} | {"email": text.contains("@"), "phone": text.contains("+")}
    rows = rows.select("id", *[F.when(hot[k], F.regexp_replace(text, F.lit(PATTERNS[k]), F.lit(f"{_MARK}$0{_MARK}"))).alias(k) for k in KINDS])
    none = F.array().cast(f"array<{_SPAN}>")
    rows = rows.select("id", *[F.when(F.col(k).contains(_MARK), _matches(F.col(k))).otherwise(none).alias(k) for k in KINDS])

    def described(kind: str) -> Column:
        def one(span: Column) -> Column:
            valid = _valid(kind, span["text"])
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"), valid.alias("valid"), F.array(*_votes(kind, span, valid)).alias("votes"), F.array(*_features(kind, span, valid)).alias("features"))

        return F.transform(kind, one)

    return rows.select("id", F.concat(*[described(k) for k in KINDS]).alias("found"))


def _posterior(votes: Column, s: Column) -> Column:
    """Probability that a span is personal data, given votes and reliabilities: s.yes[j] and s.no[j] are the chances that labeler j is right about such spans and others."""
    log_odds = F.aggregate(
        F.zip_with(votes, F.zip_with(s["yes"], s["no"], lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda v, r: F.when(v > 0, F.log(r["a"] / (1 - r["b"]))).when(v < 0, F.log((1 - r["a"]) / r["b"])).otherwise(0.0)),
        F.log(s["prior"] / (1 - s["prior"])), lambda a, x: a + x,
    )
    return 1 / (1 + F.exp(-log_odds))


def estimate_reliabilities(found: DataFrame, rounds: int = 25) -> dict[int, dict]:
    """Per kind: prior, and reliabilities of the labelers, by expectation-maximisation over the numbers of equal vote patterns.

    There are at most 27 patterns per kind, counted before anything is gathered; all rounds run in one expression over that array.
    """
    patterns = found.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    rows = patterns.groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("p"))
    trust = F.array(*[F.lit(0.8)] * 3)
    start = F.struct(F.lit(0.5).alias("prior"), trust.alias("yes"), trust.alias("no"))
    bounded = lambda x: F.least(F.greatest(x, F.lit(0.02)), F.lit(0.98))

    def total(weighted: Column, value) -> Column:
        return F.aggregate(weighted, F.lit(0.0), lambda a, w: a + value(w))

    def step(s: Column, _: Column) -> Column:
        weighted = F.transform("p", lambda p: F.struct(p["votes"].alias("v"), (p["n"] * _posterior(p["votes"], s)).alias("y"), (p["n"] * (1 - _posterior(p["votes"], s))).alias("o")))

        def update(w: Column) -> Column:
            every = total(w, lambda x: x["y"] + x["o"])
            yes = [bounded((total(w, lambda x, j=j: F.when(x["v"][j] > 0, x["y"]).otherwise(0.0)) + 4) / (total(w, lambda x, j=j: F.when(x["v"][j] != 0, x["y"]).otherwise(0.0)) + 5)) for j in range(3)]
            no = [bounded((total(w, lambda x, j=j: F.when(x["v"][j] < 0, x["o"]).otherwise(0.0)) + 4) / (total(w, lambda x, j=j: F.when(x["v"][j] != 0, x["o"]).otherwise(0.0)) + 5)) for j in range(3)]
            return F.struct(bounded((total(w, lambda x: x["y"]) + 1) / (every + 2)).alias("prior"), F.array(*yes).alias("yes"), F.array(*no).alias("no"))

        return F.element_at(F.transform(F.array(weighted), update), 1)

    out = rows.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("s"))
    return {r["kind"]: r["s"].asDict() for r in out.collect()}


def _soft_label(reliabilities: dict[int, dict]) -> Column:
    out = F.lit(0.5)
    for kind, s in reliabilities.items():
        held = F.struct(F.lit(s["prior"]).alias("prior"), F.array(*map(F.lit, s["yes"])).alias("yes"), F.array(*map(F.lit, s["no"])).alias("no"))
        out = F.when(F.col("kind") == kind, _posterior(F.col("votes"), held)).otherwise(out)
    return out


def fit_classifier(found: DataFrame, reliabilities: dict[int, dict]) -> dict[str, float]:
    """Log-odds of every feature value (and of each kind, under its name) from the soft labels: counts per feature, a bounded table."""
    soft = found.select("kind", _soft_label(reliabilities).alias("y"), "features")
    each = soft.select("y", F.explode(F.concat("features", F.array(F.concat(F.lit("kind="), F.col("kind").cast("string"))))).alias("feature"))
    sums = each.groupBy("feature").agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no")).collect()
    whole = {r["feature"]: r for r in sums}
    out = {}
    for name, r in whole.items():
        if name.startswith("kind="):
            out[name] = float(log((r["yes"] + 1) / (r["no"] + 1)))
        else:
            k = whole[f"kind={KINDS.index(name.split('/')[0])}"]
            out[name] = float(log(((r["yes"] + 1) / (k["yes"] + 4)) / ((r["no"] + 1) / (k["no"] + 4))))
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (kind, start, stop, base), one row per input row; code points, end exclusive, ordered by kind and start.

    Base spans are the valid matches of the four base patterns; they always stay. Other candidates (matches that fail a check, long runs of letters and digits) are added where the
    classifier finds them likelier personal data than not and no base span overlaps them. NULL and empty texts have no spans; rows with one id are looked at apart; other columns are left
    out; an empty table gives an empty one. U+E000 in a text counts as any other sign.
    """
    table = materialize(candidates(docs, id_col, text_col))
    found = table.select(F.explode("found").alias("f")).select("f.kind", "f.votes", "f.features")
    weights = fit_classifier(found, estimate_reliabilities(found))
    lookup = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else F.create_map().cast("map<string,double>")
    known = lambda key: F.coalesce(F.element_at(lookup, key), F.lit(0.0))
    score = lambda f: F.aggregate(f["features"], known(F.concat(F.lit("kind="), f["kind"].cast("string"))), lambda a, x: a + known(x))
    base = F.filter("found", lambda f: f["valid"])
    extra = F.filter(
        "found", lambda f: ~f["valid"] & (score(f) > 0) & ~F.exists("base", lambda b: (b["start"] < f["stop"]) & (f["start"] < b["stop"]))
    )
    plain = lambda a, is_base: F.transform(a, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["stop"].alias("stop"), F.lit(is_base).alias("base")))
    rows = table.withColumn("base", base)
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(plain("base", True), plain(extra, False))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
