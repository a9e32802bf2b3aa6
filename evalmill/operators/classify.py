"""Classification, regression and extraction metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions import extract as E
from evalmill.functions.text import strip
from evalmill.operators.ordering import dealt, running
from evalmill.operators.overlap import bag_overlap, f1_of
from evalmill.session import pin


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def auc(df: DataFrame, by, score="p1", label="label"):
    """Area under the ROC curve (ties count half) and accuracy of the larger class probability, times 100.

    Scores are first counted per distinct value; the running count of
    negatives then goes over that table in range slots, never over all rows in
    one task.
    """
    counts = df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) != 1).alias("neg"),
        F.count_if((F.col(score) > 0.5) == (F.col(label) == 1)).alias("right"),
    )
    counts = pin(counts)
    ranked = running(counts, by, F.col("_s"), F.lit(0), {"below": F.col("neg")}, rank=None)
    pairs = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return ranked.groupBy(*by).agg(
        (pairs / (F.sum("pos") * F.sum("neg")) * 100).alias("auc_score"),
        (F.sum("right") / F.sum(F.col("pos") + F.col("neg")) * 100).alias("accuracy"),
    )


def confusion(df, by, pred="answer", ref="gold"):
    return df.groupBy(*by, F.col(pred).alias("p"), F.col(ref).alias("r")).agg(F.count(F.lit(1)).alias("n"))


def _per_class(df, by, pred, ref):
    """Per class: rows predicted, rows gold, rows right. Tiny after the first aggregate."""
    cells = confusion(df, by, pred, ref)
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("p").alias("c"), F.col("n").alias("np"), F.lit(0).cast("bigint").alias("nr"), F.lit(0).cast("bigint").alias("tp")),
                F.struct(
                    F.col("r").alias("c"), F.lit(0).cast("bigint").alias("np"), F.col("n").alias("nr"),
                    F.when(F.col("p") == F.col("r"), F.col("n")).otherwise(0).alias("tp"),
                ),
            )
        ).alias("x"),
    ).select(*by, "x.*")
    return sides.groupBy(*by, "c").agg(F.sum("np").alias("np"), F.sum("nr").alias("nr"), F.sum("tp").alias("tp"))


def matthews(df, by, pred="answer", ref="gold"):
    """Multi-class Matthews correlation times 100, in closed form from the class totals."""
    d = lambda c: F.col(c).cast("double")
    sums = _per_class(df, by, pred, ref).groupBy(*by).agg(
        F.sum(d("tp")).alias("c"), F.sum(d("nr")).alias("s"), F.sum(d("np") * d("nr")).alias("pt"),
        F.sum(d("np") * d("np")).alias("pp"), F.sum(d("nr") * d("nr")).alias("tt"),
    )
    s = F.col("s")
    bottom = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    return sums.select(*by, (_ratio(F.col("c") * s - F.col("pt"), bottom) * 100).alias("matthews_correlation"))


def binary_report(df, by, pred="pred", ref="label"):
    """Accuracy, precision, recall and F1 of class 1, as fractions."""
    p, r = F.col(pred) == 1, F.col(ref) == 1
    c = df.groupBy(*by).agg(
        F.count_if(p & r).alias("tp"), F.count_if(p & ~r).alias("fp"), F.count_if(~p & r).alias("fn"),
        F.count_if(p == r).alias("right"), F.count(F.lit(1)).alias("n"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        *by, (F.col("right") / F.col("n")).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def class_report(df, by, pred="answer", ref="gold"):
    """Macro and weighted precision, recall and F1; a class without rows on one side scores 0."""
    rows = _per_class(df, by, pred, ref)
    rows = rows.withColumn("precision", _ratio(F.col("tp"), F.col("np"))).withColumn("recall", _ratio(F.col("tp"), F.col("nr")))
    rows = rows.withColumn("f1", _ratio(2 * F.col("tp"), F.col("np") + F.col("nr")))
    names = ["precision", "recall", "f1"]
    return rows.groupBy(*by).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[(F.sum(F.col(m) * F.col("nr")) / F.sum("nr")).alias(f"weighted_{m}") for m in names],
    )


def entity_micro_f1(df, by, key="item_id", pred="pred_entities", ref="gold_entities"):
    """Micro precision, recall and F1 over distinct entities per item."""
    tagged = F.concat(
        F.transform(F.array_distinct(pred), lambda e: F.struct(e.alias("e"), F.lit(1).alias("p"), F.lit(0).alias("g"))),
        F.transform(F.array_distinct(ref), lambda e: F.struct(e.alias("e"), F.lit(0).alias("p"), F.lit(1).alias("g"))),
    )
    rows = dealt(df, [*by, key]).select(*by, key, F.explode(tagged).alias("x")).select(*by, key, "x.*")
    both = rows.groupBy(*by, key, "e").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    c = both.groupBy(*by).agg(
        F.sum(F.col("p") * F.col("g")).alias("tp"), F.sum("p").alias("np"), F.sum("g").alias("ng")
    )
    tp, n_p, n_g = F.col("tp"), F.col("np"), F.col("ng")
    return c.select(
        *by, _ratio(tp, n_p).alias("precision"), _ratio(tp, n_g).alias("recall"), _ratio(2 * tp, n_p + n_g).alias("f1")
    )


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: ~F.regexp_like(c, F.lit(r"^\s*$")))


def typed_entity_f1(df, by, key="item_id", pred="said", ref="gold"):
    """Character F1 per shared type; precision over predicted and recall over gold types, per item.

    An item without gold entities is right only if nothing was predicted;
    predicting nothing where there is gold is an abstention.
    """
    shared = F.filter(F.map_keys(ref), lambda k: F.map_contains_key(F.col(pred), k))
    sizes = [F.size(pred).alias("n_p"), F.size(ref).alias("n_r")]
    pairs = df.select(*by, key, *sizes, F.explode_outer(shared).alias("type"), pred, ref)
    empty = F.array().cast("array<string>")
    side = lambda c: F.coalesce(characters(F.col(c)[F.col("type")]), empty)
    bags = bag_overlap(pairs, [*by, key, "n_p", "n_r", "type"], side(pred), side(ref))
    rows = bags.groupBy(*by, key, "n_p", "n_r").agg(F.sum(f1_of()).alias("hit"))
    hit = F.col("hit")
    precision, recall = _ratio(hit, F.col("n_p")), _ratio(hit, F.col("n_r"))
    score = F.when(F.col("n_r") == 0, (F.col("n_p") == 0).cast("double")).otherwise(
        2 * precision * recall / (precision + recall + 1e-10)
    )
    return rows.groupBy(*by).agg(
        F.avg(score).alias("score"),
        F.avg(((F.col("n_r") > 0) & (F.col("n_p") == 0)).cast("double")).alias("abstention_rate"),
    )


def mean_absolute_error(df, by, pred="prediction", ref="reference"):
    gap = F.abs(F.col(pred).try_cast("double") - F.col(ref).try_cast("double"))
    return df.groupBy(*by).agg(F.avg(gap).alias("mae"))


def row_rmse(df, by, pred="prediction", ref="reference"):
    """Mean of per-row root squared errors (a missing prediction is 0), and the true root mean square."""
    gap = F.coalesce(E.first_number(F.col(pred)), F.lit(0.0)) - E.first_number(F.col(ref))
    return df.groupBy(*by).agg(F.avg(F.abs(gap)).alias("score"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def top_k_hit(df, by, k: int, key="item_id", rank="rank", right="right"):
    """Share of items with a right answer among the first k."""
    per = df.filter(F.col(rank) <= k).groupBy(*by, key).agg(F.max(F.col(right).cast("int")).alias("hit"))
    return per.groupBy(*by).agg((F.avg("hit") * 100).alias(f"top{k}"))


def rank_scores(df, by, rank="rank", right="right"):
    return df.groupBy(*by, rank).agg((F.avg(F.col(right).cast("double")) * 100).alias("score"))


def table_cells(text: Column) -> Column:
    """Markdown table rows as normalised cell lists; rule lines dropped."""
    lines = F.filter(F.split(text, "\n"), lambda l: F.contains(l, F.lit("|")) & ~F.regexp_like(l, F.lit(r"^[\s|:-]+$")))
    return F.transform(
        lines,
        lambda l: F.array_join(F.transform(F.split(F.regexp_replace(strip(l), r"^\||\|$", ""), r"\|"), lambda c: F.lower(strip(c))), "|"),
    )


def table_f1(df, by, key="item_id", pred="prediction", ref="reference"):
    """F1 over table rows, over the set of a comma list, equality of numbers, else token F1; mean times 100."""
    p, r = F.col(pred), F.col(ref)

    def as_set(text: Column) -> Column:
        return F.array_distinct(F.transform(F.split(text, ","), lambda x: strip(x)))

    def as_number(text: Column) -> Column:
        return F.array(text.try_cast("double").cast("string"))

    def as_words(text: Column) -> Column:
        return F.filter(F.split(E.qa_normalise(text), " "), lambda w: w != "")

    numeric = p.try_cast("double").isNotNull() & r.try_cast("double").isNotNull()

    def bag(text: Column) -> Column:
        return (
            F.when(F.contains(r, F.lit("|")), table_cells(text))
            .when(F.contains(r, F.lit(",")), as_set(text))
            .when(numeric, as_number(text))
            .otherwise(as_words(text))
        )

    rows = bag_overlap(df, [*by, key], bag(p), bag(r))
    return rows.groupBy(*by).agg((F.avg(f1_of()) * 100).alias("score"))


def regression_report(df, by, y="y", fitted="y_hat"):
    """RMSE, NMSE, R2 over finite pairs, and the share of such pairs; null where undefined."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    ok = finite(y) & finite(fitted)
    gap2 = F.when(ok, (F.col(y) - F.col(fitted)) * (F.col(y) - F.col(fitted)))
    mse, spread = F.avg(gap2), F.var_pop(F.when(ok, F.col(y)))
    nmse = F.when(spread > 0, mse / spread)
    return df.groupBy(*by).agg(
        F.sqrt(mse).alias("rmse"), nmse.alias("nmse"), (1 - nmse).alias("r2"), F.avg(ok.cast("double")).alias("valid")
    )
