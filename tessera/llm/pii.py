"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides. DataFrame functions only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage
from tessera.llm.spans import MATCHES, marked_free, matches

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, written so that the matcher neither recurses nor goes back over a run: possessive where what
#: follows can't match inside, and starting only where a run starts or the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else may be a phone number: ten digits in a national form.
NATIONAL = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Gazetteers: frequent top-level domains, card issuers' prefixes, country calling codes, blocks that aren't hosts.
GAZETTEER = {
    "email": (r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us|ca|au)$", r"(?i)\.(png|jpg|gif|js|css|py|local|invalid)$"),
    "ip": (r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\.|^0[0-9]"),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)", r"^(?:[1789]|0)"),
    "phone": (r"^\+?(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]|^\(?[2-9][0-9]{2}", r"^\(?[01][0-9]{2}\)?[\x20.-]|^\+0"),
}
#: Neighbouring words that speak for and against a kind.
CONTEXT = {
    "email": (r"(?i)mail|contact|write|courriel|correo|kontakt|address", r"(?i)git clone|ssh |scp "),
    "ip": (r"(?i)\bip\b|host|server|address|login|client|from", r"(?i)version|\bv\.?$|release|section|chapter"),
    "card": (r"(?i)card|visa|master|credit|payment|karte|carte|tarjeta|pan\b", r"(?i)isbn|order|invoice|serial|\bid\b|number of|sku"),
    "phone": (r"(?i)tel|phone|call|mobile|fax|whatsapp|anruf", r"(?i)isbn|sku|version|serial|\bid\b"),
}
LABELERS = ["format", "gazetteer", "context", "border"]



def digits(x: Column) -> Column:
    """The digits of a text."""
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def step(s: Column, i: Column) -> Column:
        n = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, n).when(n > 4, n * 2 - 9).otherwise(n * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def valid(kind: str, body: Column) -> Column:
    """Whether a match of the base pattern counts."""
    n = F.length(digits(body))
    return {
        "email": F.lit(True),
        "ip": body.rlike(OCTETS),
        "card": F.when(n.between(12, 19), luhn(digits(body))).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def _votes(kind: str, m: Column, base: Column) -> Column:
    """A candidate with each labeler's vote: 0 against, 1 abstains, 2 for."""
    body = F.regexp_replace(m["body"], r"[\x20-]", "") if kind == "card" else m["body"]
    two = lambda yes, no: F.when(no, 0).when(yes, 2).otherwise(1)
    (yes, no), (cue, counter) = GAZETTEER[kind], CONTEXT[kind]
    near = F.length(digits(m["body"])) if kind != "email" else F.length(m["body"])
    bounds = {"email": (8, 40), "ip": (5, 12), "card": (14, 17), "phone": (10, 12)}[kind]
    glued = m["before"].rlike("[0-9A-Za-z.]$") | m["after"].rlike("[0-9A-Za-z]")
    return F.struct(
        m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), base.alias("base"),
        F.when(base, 2).otherwise(0).alias("format"), two(body.rlike(yes), body.rlike(no)).alias("gazetteer"),
        two(m["before"].rlike(cue), m["before"].rlike(counter)).alias("context"), F.when(glued, 0).otherwise(2).alias("border"),
        F.when(near < bounds[0], 0).when(near > bounds[1], 2).otherwise(1).alias("extent"),
    )


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row of `docs` with all candidate spans of its whole text, with votes, in the array `spans`."""
    clean = marked_free(F.coalesce(F.col(text), F.lit("")))
    guards = {"email": F.col("clean").contains("@"), "ip": F.col("clean").rlike(r"[0-9]\.[0-9]"), "card": F.col("clean").rlike("[0-9][0-9 -]{10}"), "phone": F.col("clean").contains("+")}
    rows = docs.select(*keep, clean.alias("clean"))
    rows = rows.select(*keep, *[F.when(guards[k], matches(F.col("clean"), BASE[k], KINDS.index(k))).otherwise(F.array().cast(MATCHES)).alias(f"m_{k}") for k in KINDS],
                       F.when(F.col("clean").rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"), matches(F.col("clean"), NATIONAL, KINDS.index("phone"))).otherwise(F.array().cast(MATCHES)).alias("m_national"))
    # digits that are no candidates for a card or phone at all: too few or too many
    sized = {"card": lambda m: F.length(digits(m["body"])).between(12, 19), "phone": lambda m: F.length(digits(m["body"])).between(7, 17)}
    voted = lambda k: lambda m: _votes(k, m, valid(k, m["body"]))
    spans = [F.transform(F.filter(f"m_{k}", sized[k]) if k in sized else F.col(f"m_{k}"), voted(k)) for k in KINDS]
    national = F.transform("m_national", lambda m: _votes("phone", m, F.lit(False)))
    return rows.select(*keep, F.concat(*spans).alias("sure"), national.alias("more")).select(
        *keep, F.concat("sure", F.filter("more", lambda e: ~F.exists("sure", lambda b: (b["start"] < e["stop"]) & (e["start"] < b["stop"])))).alias("spans")
    )


def estimate(patterns: list[tuple], rounds: int = 50) -> tuple[dict[tuple, float], dict[int, np.ndarray]]:
    """Expectation-maximisation over counts of vote patterns, each kind by itself.

    patterns: (kind, *votes, count). Gives the posterior of each pattern and, for each kind, every labeler's
    probabilities of its three votes given the class (labelers, class, vote).
    """
    posterior, reliability = {}, {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [p for p in patterns if p[0] == kind]
        votes, n = np.array([p[1:-1] for p in rows], int), np.array([p[-1] for p in rows], float)
        q = np.clip(0.5 + 0.2 * (votes - 1).sum(1), 0.05, 0.95)  # at first, the majority
        for _ in range(rounds):
            prior = np.clip((q * n).sum() / n.sum(), 0.02, 0.98)
            table = np.empty((votes.shape[1], 2, 3))
            for j in range(votes.shape[1]):
                for c, w in ((0, (1 - q) * n), (1, q * n)):
                    counts = np.bincount(votes[:, j], w, 3) + 0.5 + np.array([1.0, 0, 0] if c == 0 else [0, 0, 1.0])
                    table[j, c] = counts / counts.sum()
            logs = np.log(table[np.arange(votes.shape[1]), :, votes]).sum(1)
            odds = logs[:, 1] - logs[:, 0] + math.log(prior / (1 - prior))
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        reliability[kind] = table
        posterior |= {tuple(p[:-1]): float(x) for p, x in zip(rows, q, strict=True)}
    return posterior, reliability


def _row(p: tuple) -> list[float]:
    """Features of a pattern (kind, votes, extent): two for each labeler, two for the extent, and 1."""
    return [x for v in p[1:-1] for x in (float(v == 0), float(v == 2))] + [float(p[-1] == 0), float(p[-1] == 2), 1.0]


def train(patterns: list[tuple], posterior: dict[tuple, float], steps: int = 400, ridge: float = 1.0) -> dict[int, list[float]]:
    """For each kind, logistic weights of the span classifier, fitted to the posteriors as soft labels.

    patterns: (kind, *votes, extent, count).
    """
    weights = {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [p for p in patterns if p[0] == kind]
        x, n = np.array([_row(p[:-1]) for p in rows]), np.array([p[-1] for p in rows], float)
        y = np.array([posterior[p[:-2]] for p in rows])
        w, rate = np.zeros(x.shape[1]), 0.5
        for _ in range(steps):
            grade = x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) / n.sum() + ridge * w / (n.sum() + 10)
            w -= rate * grade
        weights[kind] = [float(v) for v in w]
    return weights


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every row of `docs` (doc_id, text) with its personal data: base spans, and those that the classifier adds.

    Result: doc_id, base and added (arrays of kind, start, stop in code points). Base spans are what the base patterns
    and their checks give. Other candidates (failed checks, national phone forms) are added if the span classifier
    gives them `threshold` or more. Four labelers vote on each candidate: format, gazetteer, context and border.
    Counts of vote patterns over all documents (at most 4 * 3^4 * 3 rows) go to the driver, where EM and the
    classifier's fit run on them alone.

    Null text counts as empty: no spans. Null and repeated doc_ids are ordinary rows. No candidates anywhere: nothing is
    added. Empty input: empty result. Whole texts are read, whatever their length. Further columns are ignored.
    """
    found = cut_lineage(candidates(docs))
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.{v}" for v in LABELERS], "s.extent").count().collect()  # bounded
    counts: dict[tuple, int] = {}
    for r in counted:
        counts[tuple(r[:5])] = counts.get(tuple(r[:5]), 0) + r["count"]
    posterior, _ = estimate(sorted((*k, n) for k, n in counts.items()))
    weights = train(sorted(tuple(r) for r in counted), posterior)

    def score(s: Column) -> Column:
        total = F.lit(-1.0)
        for kind, w in weights.items():
            own = F.lit(w[-1])
            for j, v in enumerate([*LABELERS, "extent"]):
                own = own + F.when(s[v] == 0, w[2 * j]).when(s[v] == 2, w[2 * j + 1]).otherwise(0.0)
            total = F.when(s["kind"] == kind, own).otherwise(total)
        return total

    limit = math.log(threshold / (1 - threshold))
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    return found.select(
        "doc_id",
        F.transform(F.filter("spans", lambda s: s["base"]), plain).alias("base"),
        F.transform(F.filter("spans", lambda s: ~s["base"] & (score(s) >= limit)), plain).alias("added"),
    )


def digest(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
