"""Personal data: candidate spans, boosted trees over format and context, thresholds set on a calibration part."""

from __future__ import annotations

import random
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, read, shown_id
from .spans import let, located, replaced, running

#: Base kinds in their order. Look-behinds and possessive loops keep the leftmost matches of the plain patterns and
#: make the search linear in the text; \G lets a match begin where the last one ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words behind which a key or password stands.
TOLD_KEY = "(?i:password|passwd|pwd|secret|token|api.?key|access.?key|credential)"
#: High-recall generators of further candidates; their spans may overlap.
GENERATORS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{10,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\) ?|0)[0-9]{2,4}[ .-]?[0-9]{3,4}(?:[ .-]?[0-9]{2,4})?(?![0-9A-Za-z])",
    # not what the key generator takes as a whole
    "secret": r"(?<=[=:]\x20?[\"']?)(?<=(?:" + TOLD_KEY + r")s?[\"']?\x20?[=:]\x20?[\"']?)"
    r"(?!(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{10,}+(?![^\s\"'<>,;=:]))[^\s\"'<>,;=:]{4,}+",
}
CONTEXT = 24
FEATURES = ["kind", "chars", "digits", "letters", "capitals", "separators", "switches", "hex", "told_key", "told_tel", "told_id", "told_bank"]
ROUNDS, RATE, PRECISION = 40, 0.3, 0.98


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def passes(kind: str, m: Column) -> Column:
    """The check that a base match must pass."""
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        turned = F.filter(F.split(F.reverse(digits(m)), ""), lambda c: c != "")
        values = F.transform(turned, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
        luhn = F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0
        return F.when(F.length(digits(m)).between(16, 19), luhn).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def told(before: Column, words: str) -> Column:
    return F.lower(before).rlike(words).cast("double")


def features(kind: int, m: Column, before: Column) -> dict[str, Column]:
    """Format of the match and context in the CONTEXT characters before it."""
    count = lambda c: F.length(F.regexp_replace(m, f"[^{c}]", "")).cast("double")
    return {
        "kind": F.lit(float(kind)), "chars": F.length(m).cast("double"), "digits": count("0-9"), "letters": count("A-Za-z"),
        "capitals": count("A-Z"), "separators": count(" ().-"),
        "switches": F.length(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "0"), "[^0]", "")).cast("double"),
        "hex": F.when(m.rlike("^[0-9a-f]+$"), 1.0).otherwise(0.0),
        "told_key": told(before, r"(password|passwd|pwd|secret|token|api.?key|access.?key|credential)[^a-z0-9]{0,6}$"),
        "told_tel": told(before, r"(tel|phone|call|mobile|fax|telefon|movil)[^a-z0-9]{0,4}$"),
        "told_id": told(before, r"(ssn|social security|sozialversicherung)[^a-z0-9]{0,12}$"),
        "told_bank": told(before, r"(iban|account|konto|cuenta|compte)[^a-z0-9]{0,6}$"),
    }


def examples(seed: int = 3, n: int = 250) -> list[tuple[str, str, str, int]]:
    """(kind, match, text before, label): invented candidates of every kind, true ones and look-alikes."""
    r = random.Random(seed)
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    d, up, low = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = ["the value of ", "see part ", "edition ", "it was ", "of the ", "and then ", "page ", "order ", "version ", "item no. "]
    out = []
    for _ in range(n):
        some = r.choice(plain)
        secret = r.choice(['password=', "password: ", 'token = "', "secret=", "api_key: ", "access key "])
        out += [
            ("key", r.choice(["AKIA", "ASIA"]) + pick(up + d, 15) + pick(d, 1), r.choice([some, secret]), 1),
            ("key", pick("0123456789abcdef", r.choice([12, 16, 18, 24, 32, 40])), secret, 1),
            ("key", pick(low + up + d, r.randint(12, 40)) + "1", secret, 1),
            ("key", pick("0123456789abcdef", r.choice([32, 40, 64])), some, 1),
            ("key", pick(low, r.randint(7, 14)) + "-" + pick(d, r.randint(1, 4)), some, 0),
            ("key", pick(d, r.randint(10, 20)), some, 0),
            ("key", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", some, 0),
            ("key", pick(low, r.randint(9, 20)) + pick(d, r.randint(1, 2)), some, 0),
            ("iban", pick(up, 2) + pick(d, 2) + pick(d, 16) + pick(d, 2), r.choice([some, "iban ", "account: "]), 1),
            ("iban", pick(up, 2) + pick(d, 2) + "".join(" " + pick(d, 4) for _ in range(4)) + " " + pick(d, 2), r.choice([some, "IBAN: "]), 1),
            ("iban", pick(up, 2) + pick(d, 2) + pick(up, 8), some, 0),
            ("iban", pick(up, 2) + pick(d, 2) + pick(up, 12), some, 0),
            ("ssn", f"{pick(d, 3)}-{pick(d, 2)}-{pick(d, 4)}", r.choice([some, "ssn ", "SSN: ", "social security number "]), 1),
            ("ssn", f"{pick(d, 3)} {pick(d, 2)} {pick(d, 4)}", r.choice(["ssn ", "social security no. "]), 1),
            ("ssn", f"{pick(d, 3)} {pick(d, 2)} {pick(d, 4)}", some, 0),
            ("tel", f"({pick(d, 3)}) {pick(d, 3)}-{pick(d, 4)}", r.choice([some, "call ", "phone: "]), 1),
            ("tel", f"0{pick(d, 2)} {pick(d, 4)} {pick(d, 4)}", r.choice(["tel ", "phone ", "Tel. "]), 1),
            ("tel", f"0{pick(d, 6)}", some, 0),
            ("tel", f"0{pick(d, 2)}.{pick(d, 3)}", some, 0),
        ]
    for _ in range(n):
        some = r.choice(plain)
        told = r.choice(["password=", "password: ", 'token = "', "secret=", "api_key: ", "pwd:"])
        slug = "-".join(pick(low, r.randint(2, 9)) for _ in range(r.randint(4, 24)))
        out += [
            ("key", pick(low + up + d, r.randint(60, 400)) + "1", some, 1),
            ("key", pick("0123456789abcdef", r.choice([96, 128, 256])), some, 1),
            ("key", f"{slug}-{pick(d, r.randint(1, 4))}", some, 0),
            ("key", pick(d, r.randint(60, 200)), some, 0),
            ("secret", pick(low, r.randint(2, 6)) + pick(d, r.randint(1, 4)) + pick("!#$%&*?" + low, r.randint(1, 3)), told, 1),
            ("secret", pick(low + up, r.randint(3, 12)) + pick(d, r.randint(1, 3)), told, 1),
            ("secret", pick(low, 1) + pick(low + up, r.randint(3, 10)) + pick(up, 1), told, 1),
            ("secret", pick(up, r.randint(0, 1)) + pick(low, r.randint(4, 12)) + r.choice(["", ".", ")"]), told, 0),
            ("secret", pick(low, r.randint(3, 9)) + "-" + pick(low, r.randint(3, 9)), told, 0),
        ]
    return out


class Trees:
    """Gradient boosting of depth-2 regression trees on the logistic loss, small enough to be one expression."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        raw, self.trees = np.full(len(y), self.start), []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), np.ones(len(y), bool), 2)
            self.trees.append(tree)
            raw += self._apply(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, own: np.ndarray, depth: int):
        leaf = float(RATE * g[own].sum() / (h[own].sum() + 1))
        best = (1e-9, None, None)
        for f in range(x.shape[1]) if depth else ():
            values = np.unique(x[own, f])
            for t in ((values[1:] + values[:-1]) / 2)[:: max(1, len(values) // 24)]:
                side = own & (x[:, f] <= t)
                rest = own & ~side
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (side, rest)) - g[own].sum() ** 2 / (h[own].sum() + 1)
                if gain > best[0] and min(side.sum(), rest.sum()) >= 20:
                    best = (gain, f, float(t))
        if best[1] is None:
            return leaf
        side = own & (x[:, best[1]] <= best[2])
        return (best[1], best[2], self._grow(x, g, h, side, depth - 1), self._grow(x, g, h, own & ~side, depth - 1))

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, t, a, b = tree
        return np.where(x[:, f] <= t, self._apply(a, x), self._apply(b, x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(self._apply(t, x) for t in self.trees))))

    def column(self, at: dict[str, Column]) -> Column:
        """The score as an expression over the features."""

        def say(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, t, a, b = tree
            return F.when(at[FEATURES[f]] <= t, say(a)).otherwise(say(b))

        return 1 / (1 + F.exp(-(F.lit(self.start) + reduce(lambda a, b: a + b, map(say, self.trees)))))


def train(spark: SparkSession) -> tuple[Trees, dict[str, float]]:
    """Trees and a threshold for each kind: the lowest at which the calibration half has the wanted precision."""
    kinds = list(GENERATORS)
    given = spark.createDataFrame(examples(), "kind string, match string, before string, label int")
    rows = []
    for i, k in enumerate(kinds):
        at = features(i, F.col("match"), F.col("before"))
        rows += given.where(F.col("kind") == k).select(*(at[f].alias(f) for f in FEATURES), "label").collect()
    x, y = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows], float)
    half = np.random.Generator(np.random.PCG64(5)).random(len(y)) < 0.5
    model = Trees(x[half], y[half])
    score, limits = model.scores(x[~half]), {}
    for i, k in enumerate(kinds):
        own = x[~half][:, 0] == i
        good = [t for t in np.unique(score[own]) if y[~half][own][score[own] >= t].mean() >= PRECISION]
        limits[k] = max(0.5, float(min(good))) - 1e-9 if good else 2.0
    return model, limits


def span_lists(text: Column, model: Trees, limits: dict[str, float]) -> tuple[dict[str, Column], dict[str, Column]]:
    """For each base kind its spans that pass, for each further kind its scored candidates."""
    base = {k: F.filter(located(text, p, 0), partial(lambda k, s: passes(k, s["match"]), k)) for k, p in BASE.items()}

    def score(i: int, k: str, s: Column) -> Column:
        at = features(i, s["match"], s["before"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"), model.column(at).alias("score"), F.lit(False).alias("base"))

    more = {}
    for i, (k, p) in enumerate(GENERATORS.items()):
        scored = F.transform(located(text, p, CONTEXT), partial(score, i, k))
        more[k] = F.filter(scored, partial(lambda k, s: s["score"] >= limits[k], k))
    return base, more


SPAN, SCORED = "struct<kind:string,start:int,end:int>", "struct<start:int,end:int,kind:string,score:double,base:boolean>"


def added(base: str, more: str) -> Column:
    """array of SPAN: the candidates of ``more`` that meet no span of ``base``; overlapping ones become one span with the
    kind of the best scored, of equal ones the first.

    Sweeps over the sorted spans, once forwards and once backwards for each of the two questions.
    """
    as_scored = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit(0.0).alias("score"), F.lit(True).alias("base")))
    both = F.array_sort(F.concat(as_scored, F.col(more)))
    # the farthest end of base spans that begin before, and from the end the start of the next base span
    reach = lambda b: running(b, F.lit(0), lambda s, x: F.when(x["base"], F.greatest(s, x["end"])).otherwise(s), lambda s, x: s, "int")
    ahead = lambda b: F.reverse(running(F.reverse(b), F.lit(2**31 - 1), lambda s, x: F.when(x["base"], x["start"]).otherwise(s), lambda s, x: s, "int"))
    clear = let(both, lambda b: let(reach(b), lambda low: let(ahead(b), lambda high: F.filter(
        b, lambda x, i: ~x["base"] & (F.get(low, i) <= x["start"]) & (F.get(high, i) >= x["end"])))))
    ends = lambda c: running(c, F.lit(0), lambda s, x: F.greatest(s, x["end"]), lambda s, x: s, "int")
    fresh = let(clear, lambda c: F.zip_with(c, ends(c), lambda x, e: F.struct(*(x[f].alias(f) for f in ("start", "end", "kind", "score")), (x["start"] >= e).alias("fresh"))))
    # from the end again: the end and the best of what follows in a run of overlapping spans, given out at its first span
    rest = F.struct(F.lit(0).alias("end"), F.lit(-1.0).cast("double").alias("score"), F.lit("").alias("kind"))
    best = lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), F.greatest(s["score"], x["score"]).alias("score"), F.when(x["score"] >= s["score"], x["kind"]).otherwise(s["kind"]).alias("kind"))
    runs = running(F.reverse(fresh), rest, lambda s, x: F.when(x["fresh"], rest).otherwise(best(s, x)),
                   lambda s, x: F.when(x["fresh"], F.struct(best(s, x)["kind"].alias("kind"), x["start"].alias("start"), best(s, x)["end"].alias("end"))), SPAN)
    done = F.reverse(F.filter(runs, lambda r: r.isNotNull()))
    return let(done, lambda d: F.concat(*(F.filter(d, partial(lambda k, r: r["kind"] == k, k)) for k in GENERATORS)))


def with_spans(docs: DataFrame, text: str, model: Trees, limits: dict[str, float]) -> DataFrame:
    """Adds _base (spans of each base kind) and _all (all spans: these, then those added), each in the order of kinds, then of starts.

    A text without a digit, an at sign or a word that tells of a key has no candidate of any kind and is not searched
    further.
    """
    col = F.coalesce(F.col(text), F.lit(""))
    gate = col.rlike("[0-9@]") | col.rlike(TOLD_KEY)
    base, more = span_lists(col, model, limits)
    tagged = [F.transform(s, partial(lambda k, v: F.struct(F.lit(k).alias("kind"), v["start"].alias("start"), v["end"].alias("end")), k)) for k, s in base.items()]
    none = F.array().cast(f"array<{SPAN}>")
    out = docs.withColumn("_base", F.when(gate, F.concat(*tagged)).otherwise(none))
    out = out.withColumn("_more", F.when(gate, F.concat(*more.values())).otherwise(F.array().cast(f"array<{SCORED}>")))
    return out.withColumn("_all", F.when(F.size("_more") > 0, F.concat("_base", added("_base", "_more"))).otherwise(F.col("_base"))).drop("_more")


def said(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, base_sha256, spans.

    Base spans are the leftmost matches of fixed patterns that pass their checks. Generators propose further
    candidates (keys and passwords, short ones where they are told, bank accounts, social security numbers, local telephone numbers), boosted
    trees score their format and the words before them, and those that reach the calibrated threshold of their
    kind and meet no base span are added; overlapping ones become one span of the best scored kind. The trees are fitted on invented
    examples, compiled to one expression, and run where the text is: no Python on executors, no shuffle.

    Null or empty text has no span; rows that repeat are searched each; a null id is shown as null.
    """
    model, limits = train(docs.sparkSession)
    out = with_spans(id_text(docs, id_col, text_col), "text", model, limits)
    counts = [F.size(F.filter("_base", partial(lambda k, s: s["kind"] == k, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select(shown_id(), *counts, F.sha2(said("_base"), 256).alias("base_sha256"), said("_all").alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in angle brackets; null stays null."""
    model, limits = train(docs.sparkSession)
    out = with_spans(docs, text, model, limits)
    by_start = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    done = replaced(F.col(text), by_start, lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">")))
    return out.withColumn(text, F.when(F.size("_all") > 0, done).otherwise(F.col(text))).drop("_base", "_all")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))
