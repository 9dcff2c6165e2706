"""Problem 8: statistics of each text, and whether it is natural prose.

All statistics are built-in expressions, so a pass over the texts stays in the JVM and moves no rows. What is prose is
told by an ordered list of rules, learned by incremental reduced-error pruning on labelled documents and applied as one
CASE expression. The learner sees the statistics of at most `max_labels` labelled documents (by hash of the id).

Null and blank texts have statistics of 0 and are never junk. Without labels there are no rules, and every text counts as prose.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELS = 20_000
MAX_WORDS = 10_000  # size bound of the table of common words, which becomes part of the plan
FEATURES = ("n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "end_punct_share", "common_share", "prose_share", "list_share", "cell_share", "repeat_share", "words_per_line")
#: Marks that end a sentence, and what parts the cells of a row, and how a list entry begins.
ENDS = ".!?:;…。！？：；"
CELLS = r"\t|\|[^|\n]*\||<t[dr]\b|;[^;\n]*;[^;\n]*;"
LIST_MARK = r"[-*+•·–—]\s|\[[ xX]\]|\(?\d{1,4}[.)\]:]\s?|\(?[A-Za-z][.)]\s|#{1,6}\s"
WORD = r"[\p{L}\p{M}&&[^\p{IsHan}]]++"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x))


def _han(words: Column) -> Column:
    """A word of the table counts for Han if it has a character of the unified ideographs or their first extension."""
    return words.rlike("[\u3400-\u4dbf\u4e00-\u9fff]")


def _patterns(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def word_lists(common_words: DataFrame) -> tuple[list[str], list[str]] | None:
    """(words written with spaces, words of Han characters) of the table, in lower case; None if it has more than MAX_WORDS."""
    rows = common_words.select(F.lower(F.trim("word")).alias("w")).where("length(w) > 0").distinct().select("w", _han(F.col("w")).alias("h")).limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        return None
    return sorted(r["w"] for r in rows if not r["h"]), sorted(r["w"] for r in rows if r["h"])


def statistics(df: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", features: tuple[str, ...] = FEATURES, only_where: dict[str, Column] | None = None) -> DataFrame:
    """(id, n_lines, *features) of every row; n_lines counts lines that aren't blank. Only what the features need is worked out.

    only_where gives conditions over the other features; a feature named there is null where its condition doesn't hold.

    A word is a run of letters and marks; each Han character counts as a word of its own. common_share: of words, those in the table
    (for Han, of characters those in a common word). prose_share: of characters, those in lines with enough common words.
    A table of common words beyond MAX_WORDS isn't put into the plan: the words of the texts are joined with it, to the same result
    (there each run of Han characters is looked through for words of the table by their lengths).
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n?|\u2028|\u0085", "\n")
    if "common_share" in features or "prose_share" in features:
        lists = word_lists(common_words)
        if lists is None:
            return _joined(df, common_words, id_col, text_col, features)
        spaced, han = lists
    else:
        spaced, han = [], []
    han_pattern = _patterns(han) or "(?!)"
    a = df.select(F.col(id_col).alias("__id"), text.alias("t"))
    size, n_lines = F.length("t"), F.regexp_count("t", F.lit(r"\S[^\n]*+"))
    words, n_words, shown = F.col("w"), F.size("w") + F.col("h"), F.col("n_shown")

    def left(pattern: str, of: Column) -> Column:
        """How many characters the matches of a pattern hold."""
        return F.length(of) - F.length(F.regexp_replace(of, pattern, ""))

    def common(found: Column) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(spaced))) if spaced else F.lit(0)

    def common_han(of: Column, n: Column) -> Column:
        return F.when(n > 0, left(han_pattern, of)).otherwise(0)

    def prose_chars() -> Column:
        def told(x: Column) -> Column:
            found = F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))
            h = F.when(x.rlike(r"\p{IsHan}"), left(r"\p{IsHan}+", x)).otherwise(0)
            return F.struct(F.length(x).alias("n"), F.size(found).alias("w"), common(found).alias("c"), h.alias("h"), common_han(x, h).alias("hc"))

        def prose(x: Column) -> Column:
            return ((x["c"] * 5 >= x["w"]) & (x["c"] > 0) & (x["w"] > 1)) | ((x["h"] > 3) & (x["hc"] * 5 >= x["h"]))

        return F.aggregate(F.transform(F.split("t", "\n"), told), F.lit(0), lambda n, x: n + F.when(prose(x), x["n"]).otherwise(0))

    parts = F.col("parts")
    made = {
        "n_words": lambda: n_words.cast("long"),
        "mean_word_len": lambda: _ratio(F.length(F.array_join(words, "")) + F.col("h"), n_words),
        "symbol_ratio": lambda: _ratio(left(r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()。，、；：！？“”‘’（）-]+", F.col("t")), size),
        "digit_ratio": lambda: _ratio(left("[0-9]+", F.col("t")), size),
        "end_punct_share": lambda: _ratio(F.regexp_count("t", F.lit(f"(?m)[{ENDS}][\"')”’»]*[^\\S\\n]*$")), F.col("n_lines")),
        "common_share": lambda: _ratio(common(words) + common_han(F.col("t"), F.col("h")), n_words),
        "prose_share": lambda: _ratio(prose_chars(), shown),
        "list_share": lambda: _ratio(left(f"(?m)^[^\\S\\n]*(?:{LIST_MARK})[^\\n]*", F.col("t")), shown),
        "cell_share": lambda: _ratio(left(f"(?m)^[^\\n]*?(?:{CELLS})[^\\n]*", F.col("t")), shown),
        "repeat_share": lambda: _ratio(F.length(F.array_join(parts, "")) - F.length(F.array_join(F.array_distinct(parts), "")), F.length(F.array_join(parts, ""))),
        "words_per_line": lambda: _ratio(n_words, F.col("n_lines")),
    }
    a = a.withColumn("n_lines", n_lines)
    if set(features) & {"n_words", "mean_word_len", "common_share", "words_per_line"}:
        a = a.withColumn("w", F.regexp_extract_all(F.lower("t"), F.lit(WORD), F.lit(0))).withColumn("h", F.when(F.col("t").rlike(r"\p{IsHan}"), left(r"\p{IsHan}+", F.col("t"))).otherwise(0))
    if set(features) & {"prose_share", "list_share", "cell_share"}:
        a = a.withColumn("n_shown", F.length(F.translate("t", "\n", "")))
    if "repeat_share" in features:
        a = a.withColumn("parts", F.filter(F.split("t", r"(?<=[.!?。！？])|\n"), lambda x: F.length(x) > 12))
    # explode of one element: filters on what follows must not be pushed below, where they'd repeat the work for each mention
    later = {f: c for f, c in (only_where or {}).items() if f in features}
    told = a.select("__id", "t", *(["n_shown"] if set(later) & {"prose_share", "list_share", "cell_share"} else []), F.explode(F.array(F.struct("n_lines", *[made[f]().alias(f) for f in features if f not in later]))).alias("f"))
    if not later:
        return told.select(F.col("__id").alias(id_col), "f.*")
    told = told.select("*", "f.*").withColumn("g", F.explode(F.array(F.struct(*[F.when(c, made[f]()).alias(f) for f, c in later.items()]))))
    return told.select(F.col("__id").alias(id_col), "n_lines", *[F.col(f"g.{f}") if f in later else F.col(f"f.{f}") for f in features])


def _joined(df: DataFrame, common_words: DataFrame, id_col: str, text_col: str, features: tuple[str, ...]) -> DataFrame:
    """`statistics` with a table of common words of any size: words counted by line are joined with it, for Han all cuts of a line of the table's lengths.

    Texts go by id and digest, so that repeated rows count once here and are joined again.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    keyed = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), digest.alias("__key"))
    known = common_words.select(F.lower(F.trim("word")).alias("word")).where("length(word) > 0").distinct()
    han = known.where(_han(F.col("word")))
    # a column of the plan, not a collection of words: how long words of Han can be
    lengths = han.agg(F.sort_array(F.collect_set(F.length("word"))).alias("lengths"))
    text = F.regexp_replace(F.coalesce(F.col("__text"), F.lit("")), r"\r\n?|\u2028|\u0085", "\n")
    lines = keyed.dropDuplicates(["__id", "__key"]).select("__id", "__key", F.posexplode(F.split(text, "\n")).alias("k", "x"))
    h = F.when(F.col("x").rlike(r"\p{IsHan}"), F.length("x") - F.length(F.regexp_replace("x", r"\p{IsHan}+", ""))).otherwise(0)
    lines = lines.withColumn("h", h).withColumn("w", F.regexp_extract_all(F.lower("x"), F.lit(WORD), F.lit(0)))
    at = ["__id", "__key", "k"]
    spaced = lines.select(*at, F.explode("w").alias("word")).groupBy(*at, "word").count().join(known.where(~_han(F.col("word"))), "word").groupBy(*at).agg(F.sum("count").alias("c"))
    cuts = lines.where("h > 0").crossJoin(F.broadcast(lengths)).select(*at, "x", F.explode("lengths").alias("n")).where("n <= length(x)").select(*at, "x", "n", F.explode(F.expr("sequence(1, length(x) - n + 1)")).alias("i")).select(*at, "n", "i", F.expr("substring(x, i, n)").alias("word"))
    matches = cuts.join(han, "word").groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("i", (-F.col("n")).alias("n")))).alias("m"))
    # from the left, the longest first, none over another
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hc"))
    taken = F.aggregate("m", start, lambda s, m: F.when(m["i"] > s["end"], F.struct((m["i"] - m["n"] - 1).alias("end"), (s["hc"] - m["n"]).alias("hc"))).otherwise(s))
    matches = matches.select(*at, taken["hc"].alias("hc"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in at]
    told = lines.alias("l").join(spaced.alias("r"), on, "left").select("l.*", F.coalesce("c", F.lit(0)).alias("c"))
    told = told.alias("l").join(matches.alias("r"), on, "left").select("l.*", F.coalesce("hc", F.lit(0)).alias("hc"))
    n_words = F.size("w") + F.col("h")
    prose = ((F.col("c") * 5 >= F.size("w")) & (F.col("c") > 0) & (F.size("w") > 1)) | ((F.col("h") > 3) & (F.col("hc") * 5 >= F.col("h")))
    sums = told.groupBy("__id", "__key").agg(
        _ratio(F.sum(F.col("c") + F.col("hc")), F.sum(n_words)).alias("common_share"), _ratio(F.sum(F.when(prose, F.length("x")).otherwise(0)), F.sum(F.length("x"))).alias("prose_share")
    )
    wanted = {"common_share", "prose_share"} & set(features)
    rest = statistics(keyed.select(F.struct("__id", "__key").alias("__both"), "__text"), common_words, "__both", "__text", tuple(f for f in features if f not in wanted))
    both = rest.select(F.col("__both.__id").alias("__id"), F.col("__both.__key").alias("__key"), "n_lines", *(f for f in features if f not in wanted)).alias("l").join(sums.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in at[:2]])
    return both.select(F.col("l.__id").alias(id_col), "n_lines", *features)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.threshold) if self.above else F.col(self.feature) < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int, steps: int) -> Rule:
    """Add the condition of the largest information gain until no negative is covered or nothing gains."""
    inside, rule = np.ones(y.size, bool), ()
    while len(rule) < most and (y & inside).any() and (~y & inside).any():
        p0, n0 = (y & inside).sum(), (~y & inside).sum()
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for f, v in x.items():
            cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, steps)))
            for c in (cuts[1:] + cuts[:-1]) / 2:
                for above in (True, False):
                    hit = inside & ((v >= c) if above else (v < c))
                    p, n = (y & hit).sum(), (~y & hit).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - before)
                        if gain > best[0]:
                            best = (gain, Condition(f, above, float(f"{c:.6g}")), hit)
        if best[1] is None:
            break
        rule, inside = (*rule, best[1]), inside & best[1].holds(x)
    return rule


def learn(x: dict[str, np.ndarray], y: np.ndarray, fold: np.ndarray, most: int = 3, steps: int = 60, least_precision: float = 0.6, most_rules: int = 12) -> list[Rule]:
    """Ordered rules for y, by incremental reduced-error pruning; fold (0 to 2) is 0 for the rows that prune.

    Each rule is grown on two thirds of what is left, cut back from its end while that raises (p - n) / (p + n) on the
    other third, and kept if its precision there reaches `least_precision`. What it covers is taken away.
    """
    rules: list[Rule] = []
    left = np.ones(y.size, bool)
    while len(rules) < most_rules and (y & left).any():
        g, v = left & (fold != 0), left & (fold == 0)
        rule = _grow({k: a[g] for k, a in x.items()}, y[g], most, steps)
        if not rule:
            break

        def value(r: Rule) -> float:
            hit = covers(r, x) & v
            p, n = (y & hit).sum(), (~y & hit).sum()
            return (p - n) / (p + n) if p + n else -1.0

        best = max((rule[:k] for k in range(len(rule), 0, -1)), key=value)
        hit = covers(best, x) & left
        p, n = (y & hit & v).sum(), (~y & hit & v).sum()
        if p + n == 0:
            p, n = (y & hit).sum(), (~y & hit).sum()
        if p < least_precision * (p + n):
            break
        rules.append(best)
        left &= ~hit
    return rules


def train(stats: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, id_col: str = "doc_id", prose: str = "prose") -> list[Rule]:
    """Rules for what isn't prose. Labels that are null, or of which a document has differing ones, are left out."""
    votes = labels.where("label is not null").groupBy(id_col).agg(F.min(F.col("label") != prose).alias("a"), F.max(F.col("label") != prose).alias("b")).where("a = b").select(id_col, F.col("a").cast("int").alias("y"))
    bounded = votes.orderBy(F.xxhash64(id_col), id_col).limit(max_labels)
    rows = stats.join(F.broadcast(bounded), id_col).where("n_words > 0").select("y", F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(3)).alias("fold"), *FEATURES).toPandas()
    if rows.empty or rows["y"].sum() < 3:
        return []
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["y"].to_numpy() == 1, rows["fold"].to_numpy())


def junk(rules: list[Rule]) -> Column:
    """The rule list as CASE WHEN ... THEN true ... ELSE false END."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, True) if out is None else out.when(test, True)
    return F.lit(False) if out is None else out.otherwise(False)


def named(rules: list[Rule]) -> tuple[str, ...]:
    """The statistics that rules ask for."""
    return tuple(f for f in FEATURES if any(c.feature == f for r in rules for c in r))


def _needed(rules: list[Rule], feature: str) -> dict[str, Column]:
    """Where a statistic can decide: where all other conditions of some rule that names it hold."""
    out = None
    for rule in rules:
        others = [c.column() for c in rule if c.feature != feature]
        if len(others) < len(rule):
            holds = F.lit(True)
            for c in others:
                holds = holds & c
            out = holds if out is None else out | holds
    return {} if out is None else {feature: out}


def rules_of(documents: DataFrame, labels: DataFrame, common_words: DataFrame, max_labels: int = MAX_LABELS) -> list[Rule]:
    """The rules learned on the labelled documents, whose statistics are the only ones worked out here."""
    known = labels.select("doc_id").where("label is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_labels)
    return train(statistics(documents.join(F.broadcast(known), "doc_id", "left_semi"), common_words), labels, max_labels)


def _told(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    return stats.withColumn("is_prose", F.when(F.col("n_lines") > 0, ~junk(rules)))


def classify(documents: DataFrame, labels: DataFrame, common_words: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """The statistics of every document with is_prose: not covered by a rule. Blank texts: null."""
    return _told(statistics(documents, common_words), rules_of(documents, labels, common_words, max_labels))


def found(documents: DataFrame, labels: DataFrame, common_words: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id) of the documents that aren't prose, as `classify` tells; of the statistics only those that the rules name are worked out.

    prose_share looks at the words of each line by itself; it is worked out where the other conditions of a rule that names it hold.
    """
    rules = rules_of(documents, labels, common_words, max_labels)
    return _told(statistics(documents, common_words, features=named(rules), only_where=_needed(rules, "prose_share")), rules).where("not is_prose").select("doc_id")
