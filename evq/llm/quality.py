"""Quality rules of documents and of the hosts they come from, in DataFrame functions only.

A document is measured in one pass inside its row. Rule failures are added up per host (a hot host is added up in every
task before the shuffle), the rate of a host is shrunk towards all hosts by a beta prior fitted to them (method of
moments), and the verdicts of a host go back to its documents by a join that adaptive execution can split or broadcast.

- A host is bad when its shrunk rate of failing documents reaches ``host_limit``: none of its documents is kept.
- A document that fails a rule of form (symbols, repeated lines, word length) is dropped if its host's shrunk rate for
  that rule reaches ``habit_limit``, so that one odd page of a good host is not enough.
- A document that fails the base rules (too short, too many repeated windows) is dropped.

Null or empty text has no words and fails; a null host is a host of its own; repeated rows count repeatedly; an empty table
gives no rows. Words are runs of characters other than U+0020 and U+0009-000D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Rules of form by name; they read the measures.
FORM = {
    "symbols": "n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
    "length": "word_chars > 15 * n_words or word_chars < 2 * n_words",
}
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
HOST_LIMIT, HABIT_LIMIT = 0.5, 0.02
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text", into: str = "__q") -> DataFrame:
    """``docs`` with the struct column ``into``: the measures, base_failed and one flag per rule of form.

    Each step is a projection of its own, because a lambda evaluates what it refers to once per element unless that is a
    finished column. Windows are compared as hashes first; only texts with equal hashes compare the windows themselves.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns]
    t, words, windows, ordered, places = (f"{into}_{x}" for x in ("text", "words", "windows", "ordered", "places"))
    one = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(t))
    one = one.select("*", F.filter(F.split(t, SPACE), lambda w: w != "").alias(words))
    last = F.size(words) - WINDOW

    def at(i: Column, k: int) -> Column:
        return F.get(F.col(words), i + k)

    two = one.select("*", F.when(last >= 1, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))).alias(windows))
    three = two.select("*", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.array_sort(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.struct(
            F.concat_ws(" ", *(at(i, k) for k in range(WINDOW))).alias("g"), i.alias("i"))))).alias(ordered))
    near = [lambda i, d=d: F.get(F.col(ordered), i + d)["g"] for d in (-1, 1)]
    four = three.select("*", F.array_sort(F.transform(F.filter(
        F.col(ordered), lambda x, i: F.coalesce(near[0](i) == x["g"], F.lit(False)) | F.coalesce(near[1](i) == x["g"], F.lit(False))),
        lambda x: x["i"])).alias(places))
    covered = F.aggregate(
        F.col(places), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    five = four.select(
        *kept, F.size(words).cast("long").alias(f"{into}n_words"), F.length(F.array_join(words, "")).cast("long").alias(f"{into}word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias(f"{into}n_symbols"), lines.alias(f"{into}lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias(f"{into}n_repeat_words"))
    six = five.select(
        "*", F.size(f"{into}lines").cast("long").alias(f"{into}n_lines"),
        (F.size(f"{into}lines") - F.size(F.array_distinct(f"{into}lines"))).cast("long").alias(f"{into}n_dup_lines"))
    measures = F.struct(*(F.col(f"{into}{m}").alias(m) for m in MEASURES))
    rules = {"base_failed": BASE_FAILED, **FORM}
    seven = six.select(*kept, measures.alias(into))

    def rule(condition: str) -> Column:
        for m in MEASURES:
            condition = condition.replace(m, f"{into}.{m}")
        return F.expr(condition)

    return seven.withColumn(into, F.struct(
        *(F.col(f"{into}.{m}").alias(m) for m in MEASURES), *(rule(c).alias(name) for name, c in rules.items())))


def host_verdicts(measured: DataFrame, host: Column, into: str = "__q", host_limit: float = HOST_LIMIT,
                  habit_limit: float = HABIT_LIMIT) -> DataFrame:
    """One row per host: ``host``, its number of documents, shrunk rates, ``bad`` and a ``habit_<rule>`` flag per rule of form."""
    flags = {"any": F.col(f"{into}.base_failed"), **{r: F.col(f"{into}.{r}") for r in FORM}}
    for r in FORM:
        flags["any"] = flags["any"] | flags[r]
    sums = measured.groupBy(host.alias("host")).agg(
        F.count("*").alias("n"), *(F.sum(c.cast("long")).alias(f"f_{r}") for r, c in flags.items()))
    total = sums.agg(F.count("*").alias("k"), F.sum("n").alias("n"), *(F.sum(f"f_{r}").alias(f"f_{r}") for r in flags),
                     *(F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"s_{r}") for r in flags)).first()  # one row
    out = [F.col("host"), F.col("n")]
    for r in flags:
        mean, strength = beta_prior(total["k"], total["n"] or 0, total[f"f_{r}"] or 0, total[f"s_{r}"] or 0.0)
        out.append(((F.col(f"f_{r}") + mean * strength) / (F.col("n") + strength)).alias(f"rate_{r}"))
    rates = sums.select(*out)
    return rates.select("*", (F.col("rate_any") >= host_limit).alias("bad"),
                        *((F.col(f"rate_{r}") >= habit_limit).alias(f"habit_{r}") for r in FORM))


def beta_prior(hosts: int, n: int, failed: int, squares: float) -> tuple[float, float]:
    """(mean, strength) of the beta distribution of host rates, from the sum of failed**2 / n over hosts.

    The variance between hosts is what exceeds the binomial one; with none left, hosts are alike and the strength is n.
    """
    if not n:
        return 0.5, 1.0
    mean = failed / n
    inside = mean * (1 - mean)
    between = squares / n - mean * mean - inside * hosts / n
    if inside == 0 or between <= inside / (n + 1):
        return mean, float(n)
    return mean, max(inside / between - 1, 1.0)


def judge(docs: DataFrame, host: str = "source", text: str = "text", into: str = "__q", host_limit: float = HOST_LIMIT,
          habit_limit: float = HABIT_LIMIT, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with the struct ``into`` (see ``measure``) and the boolean ``<into>_kept``.

    The measured rows are written once and read for the host sums and for the verdicts: leave long texts out of ``keep``.
    """
    keep = tuple(docs.columns) if keep is None else keep
    columns = [F.col(f"`{c}`") for c in dict.fromkeys([*keep, host])]
    measured = materialize(measure(docs, text, into).select(*columns, into), "quality")
    key = F.coalesce(F.concat(F.lit("host "), F.col(host).cast("string")), F.lit("no host"))
    verdicts = host_verdicts(measured, key, into, host_limit, habit_limit)
    verdicts = verdicts.select(F.col("host").alias(f"{into}_host"), F.struct("bad", *(f"habit_{r}" for r in FORM)).alias(f"{into}_v"))
    joined = measured.withColumn(f"{into}_host", key).join(verdicts, f"{into}_host")
    dropped = F.col(f"{into}.base_failed") | F.col(f"{into}_v.bad")
    for r in FORM:
        dropped = dropped | (F.col(f"{into}.{r}") & F.col(f"{into}_v.habit_{r}"))
    return joined.select(*(F.col(f"`{c}`") for c in keep), into, (~dropped).alias(f"{into}_kept"))
