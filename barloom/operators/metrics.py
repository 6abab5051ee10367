"""Prediction-set metrics, calibration and uncertainty.

A prediction set has row_id (a total order), label (0/1), p (probability of 1) and, where used, mu, sigma, ret, ts,
ticker. Metrics that need ranks group by probability first, so that the ordered scan runs over distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.columns import softplus
from barloom.staging import settled


def _div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(default))


def meet(df: DataFrame, figures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """df with its group's row of figures; without groups figures is exactly one row."""
    return df.join(figures, list(by)) if by else df.crossJoin(F.broadcast(figures))


def confusion(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """One row a group: counts at p >= threshold and the figures derived from them; undefined ones are 0."""
    hit, yes = F.col("p") >= threshold, F.col("label") == 1
    row = df.groupBy(*by).agg(
        F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & ~yes).alias("tn"), F.count_if(~hit & yes).alias("fn"),
        F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    row = row.withColumns(
        {"accuracy": _div(tp + tn, tp + fp + tn + fn), "prec": _div(tp, tp + fp), "recall": _div(tp, tp + fn), "specificity": _div(tn, tn + fp), "npv": _div(tn, tn + fn)}
    )
    f1 = _div(2 * F.col("prec") * F.col("recall"), F.col("prec") + F.col("recall"))
    f0 = _div(2 * F.col("npv") * F.col("specificity"), F.col("npv") + F.col("specificity"))
    return row.withColumns(
        {
            "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2,
            "f1_pos": f1,
            "f1_neg": f0,
            "macro_f1": (f1 + f0) / 2,
            "mcc": _div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        }
    ).drop("npv")


PARTS = 256


def with_before(by_value: DataFrame, value: str, n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Adds before: the sum of n over smaller values of the group. One row per group and value.

    Values are cut into ranges by a rising function of the whole line into 0 to PARTS; running sums are taken within
    ranges and over one row per range, so that no task holds the whole order.
    """
    part = F.floor((F.atan(F.col(value)) / math.pi + 0.5) * PARTS).cast("int")
    by_value = by_value.withColumn("part", part)
    ranges = by_value.groupBy(*by, "part").agg(F.sum(n).alias("whole"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "part", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("at"))
    inner = Window.partitionBy(*by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = by_value.withColumn("own", F.coalesce(F.sum(n).over(inner), F.lit(0))).join(ranges, [*by, "part"])
    return rows.withColumn("before", F.col("at") + F.col("own")).drop("part", "at", "own")


def auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a group: area under the ROC curve with tied ranks averaged; null if one class is missing."""
    by_p = with_before(df.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")), "p", by=by)
    row = by_p.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").alias("P"), F.sum("n").alias("n"))
    p, neg = F.col("P").cast("double"), (F.col("n") - F.col("P")).cast("double")
    return row.select(*by, F.when((p > 0) & (neg > 0), (F.col("ranks") - p * (p + 1) / 2) / F.when(p * neg > 0, p * neg)).alias("auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """One row: mean precision at each positive by falling p, ties in row order; null without positives.

    Rows are cut by probability into ranges with running counts, so that no task holds the whole order.
    """
    df = df.withColumn("part", F.floor(F.col("p") * 256).cast("int"))
    parts = df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    w = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("pos").over(w), F.lit(0)).alias("p0"))
    inner = Window.partitionBy("part").orderBy(F.col("p").desc(), "row_id")
    rows = df.withColumns({"rn": F.row_number().over(inner), "tp": F.sum("label").over(inner.rowsBetween(Window.unboundedPreceding, 0))}).join(parts, "part")
    return rows.where("label = 1").agg(F.avg((F.col("p0") + F.col("tp")) / (F.col("n0") + F.col("rn"))).alias("average_precision"))


def expected_calibration_error(df: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    cells = df.groupBy(*by, F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("acc"), F.avg("p").alias("conf")
    )
    return cells.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def return_metrics(df: DataFrame, dof: float = 3.0) -> DataFrame:
    """One row: Gaussian and Student-t likelihood losses, absolute and squared return errors, means."""
    scale = softplus(F.col("log_scale")) + 1e-6
    z = (F.col("ret") - F.col("mu")) / scale
    gauss = 0.5 * (math.log(2 * math.pi) + 2 * F.ln(scale) + z * z)
    const = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)
    student = -(F.lit(const) - F.ln(scale) - (dof + 1) / 2 * F.log1p(z * z / dof))
    err = F.col("mu") - F.col("ret")
    return df.agg(
        F.avg(gauss).alias("gaussian_nll"), F.avg(student).alias("student_t_nll"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg("mu").alias("mean_pred"), F.avg("ret").alias("mean_actual"),
    )


def metric_bundle(df: DataFrame) -> DataFrame:
    """All of the above in one row; every part is one row, so the joins are of single rows."""
    out = confusion(df)
    for part in (auc(df), average_precision(df), expected_calibration_error(df), return_metrics(df)):
        out = out.crossJoin(part)
    return out


def pos_weight(df: DataFrame) -> DataFrame:
    pos, n = F.sum("label").cast("double"), F.count(F.lit(1)).cast("double")
    return df.agg(F.when(pos > 0, (n - pos) / F.when(pos > 0, pos)).otherwise(1.0).alias("pos_weight"))


TEMPERATURES = 151


def temperature_scaling(df: DataFrame, by: Sequence[str] = (), least_rows: int = 0) -> DataFrame:
    """Per group: the temperature of a fixed grid on [0.25, 4] with the least log loss (1 first), losses and Brier scores.

    Each row meets the 152 grid values in the task that holds it; partial sums per temperature are all that is shuffled.
    """
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    df = df.withColumn("logit", F.ln(p / (1 - p)))
    grid = F.concat(F.array(F.struct(F.lit(-1).alias("k"), F.lit(1.0).alias("temperature"))), F.transform(
        F.sequence(F.lit(0), F.lit(TEMPERATURES - 1)), lambda k: F.struct(k.alias("k"), (0.25 + k * (3.75 / (TEMPERATURES - 1))).alias("temperature"))))
    rows = df.select(*by, "label", "logit", F.inline(grid).alias("k", "temperature"))
    q = 1 / (1 + F.exp(-F.col("logit") / F.col("temperature")))
    q = F.least(F.greatest(q, F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -F.when(F.col("label") == 1, F.ln(q)).otherwise(F.ln(1 - q))
    sums = rows.groupBy(*by, "k", "temperature").agg(F.avg(loss).alias("nll"), F.avg(F.pow(q - F.col("label"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))
    before = lambda c: F.max(F.when(F.col("k") == -1, F.col(c)))
    key = F.struct(F.round("nll", 12), "k")
    out = sums.groupBy(*by).agg(
        F.min_by("temperature", key).alias("temperature"), before("nll").alias("nll_before"), F.min("nll").alias("nll_after"),
        before("brier").alias("brier_before"), F.min_by("brier", key).alias("brier_after"), F.max("n").alias("n"),
    )
    if least_rows and by:
        overall = temperature_scaling(df).select(F.col("temperature").alias("overall"))
        out = out.crossJoin(F.broadcast(overall)).withColumn("temperature", F.when(F.col("n") >= least_rows, F.col("temperature")).otherwise(F.col("overall"))).drop("overall")
    return out


def isotonic_steps(df: DataFrame, by: str = "bucket", bins: int = 10) -> DataFrame:
    """(by, step, upper, value): equal-count chunks of the sorted probabilities and the running maximum of their hit rates.

    A row's place is the number of rows with smaller probabilities, by ranges of them, and its place among its equals.
    """
    counts = with_before(df.groupBy(by, "p").agg(F.count(F.lit(1)).alias("k")), "p", "k", [by]).select(by, "p", "before")
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.lit(1), F.floor(F.col("n") / bins))
    among = F.row_number().over(Window.partitionBy(by, "p").orderBy("row_id")) - 1
    rows = df.select(by, "p", "label", among.alias("among")).join(counts, [by, "p"]).join(sizes, by)
    rows = rows.withColumn("step", F.least(F.floor((F.col("before") + F.col("among")) / size), F.lit(bins - 1)))
    steps = rows.groupBy(by, "step").agg(F.max("p").alias("upper"), F.avg(F.col("label").cast("double")).alias("rate"))
    up = Window.partitionBy(by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("value", F.max("rate").over(up)).drop("rate")


def calibrated_scores(df: DataFrame, steps: DataFrame, temperatures: DataFrame, by: str = "bucket") -> DataFrame:
    """df with p_temperature (p's logit over its group's temperature) and p_isotonic (the value of the first step whose upper end reaches p).

    A p above all steps takes the last one's value; a group without steps or temperature keeps p. A group has as many
    steps as bins, so they travel as one array and are looked up in it: rows are joined once, by group.
    """
    ladder = steps.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("step", "upper", "value"))).alias("ladder"))
    rows = df.join(ladder, by, "left").join(temperatures.select(by, "temperature"), by, "left")
    reached = F.get(F.filter("ladder", lambda s: s.upper >= F.col("p")), F.lit(0)).value
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    cooled = 1 / (1 + F.exp(-F.ln(p / (1 - p)) / F.col("temperature")))
    found = {"p_temperature": F.coalesce(cooled, F.col("p")), "p_isotonic": F.coalesce(reached, F.element_at("ladder", -1).value, F.col("p"))}
    return rows.withColumns(found).drop("ladder", "temperature")


#: Cells that a round of top_share cuts a range of values into, rounds, and row numbers of a block.
CELLS, ROUNDS, BLOCK = 1024, 2, 1 << 16


def top_share(df: DataFrame, share: float | Column, score: Column, by: Sequence[str] = ()) -> DataFrame:
    """Of each group the max(1, int(n * share)) rows with the highest score, ties in row order; NaN counts as the largest score, null as the least.

    The k-th value is found without sorting rows: distinct values with their counts are counted by cells of their
    range, then by cells of the range within the cell that holds the k-th, and only the values of the last cell are
    ordered. Of the rows with just that value those up to a row_id stay, which is looked up in blocks of row_id. The
    share may be a column of `by`. Scores and row numbers are settled first, as each step reads them.
    """
    by, largest = list(by), 1.7e308
    share = F.lit(share) if isinstance(share, (int, float)) else share
    score = F.coalesce(score.cast("double"), F.lit(-largest))  # least and greatest would pass over a null
    value = F.when(F.isnan(score), largest).otherwise(F.greatest(F.least(score, F.lit(largest)), F.lit(-largest)))
    df = df.withColumn("__s", value)
    scored = settled(df.select(*by, "__s", "row_id"))
    values = scored.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("n"))
    edge = values.groupBy(*by).agg(F.sum("n").alias("total"), F.min("__s").alias("lo"), F.max("__s").alias("hi"))
    wanted = F.least(F.col("total"), F.greatest(F.lit(1), F.floor(F.col("total") * share)))
    edge = edge.select(*by, "lo", "hi", wanted.alias("wanted"))
    group = Window.partitionBy(*by)

    def holding(cells: DataFrame, order: Column) -> DataFrame:
        """The row of `cells` that holds the wanted place, which becomes a place within it."""
        above = F.coalesce(F.sum("n").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.withColumn("above", above).where("above < wanted AND wanted <= above + n")
        return cells.withColumn("wanted", F.col("wanted") - F.col("above")).drop("above")

    for _ in range(ROUNDS):
        inside = meet(values, edge, by).where(F.col("__s").between(F.col("lo"), F.col("hi")))
        place = (F.col("__s") / 2 - F.col("lo") / 2) / F.when(F.col("hi") > F.col("lo"), F.col("hi") / 2 - F.col("lo") / 2)
        cell = F.least(F.floor(F.coalesce(place, F.lit(0.0)) * CELLS), F.lit(CELLS - 1))
        cells = inside.groupBy(*by, cell.alias("cell")).agg(F.sum("n").alias("n"), F.min("__s").alias("lo"), F.max("__s").alias("hi"), F.max("wanted").alias("wanted"))
        edge = holding(cells, F.col("cell").desc()).select(*by, "lo", "hi", "wanted")
    last = holding(meet(values, edge, by).where(F.col("__s").between(F.col("lo"), F.col("hi"))), F.col("__s").desc())
    last = last.select(*by, F.col("__s").alias("cut"), "wanted")
    ties = meet(scored, last, by).where("__s = cut")
    ties = ties.groupBy(*by, F.floor(F.col("row_id") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("row_id")).alias("ids"), F.max("wanted").alias("wanted"), F.max("cut").alias("cut"))
    upto = holding(ties.withColumn("n", F.size("ids")), F.col("block")).select(*by, "cut", F.element_at("ids", F.col("wanted").cast("int")).alias("last_id"))
    return meet(df, upto, by).where("__s > cut OR (__s = cut AND row_id <= last_id)").drop("__s", "cut", "last_id")


def precision_at(df: DataFrame, share: float) -> DataFrame:
    return top_share(df, share, F.abs("score")).agg(F.count(F.lit(1)).alias("k"), F.avg(F.col("label").cast("double")).alias("precision_at_k"))


def confidence_buckets(df: DataFrame, shares: Sequence[float] = (0.05, 0.10, 0.20)) -> DataFrame:
    """Per share of the most confident rows: count, hit rate and mean signed return."""
    sign = F.when(F.col("p") >= 0.5, 1).otherwise(-1)
    hit = ((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double")
    rows = df.select("row_id", "p", "label", "ret", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    chosen = top_share(rows, F.col("share"), F.greatest(F.col("p"), 1 - F.col("p")), ["share"])
    return chosen.groupBy("share").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("hit_rate"), F.avg(sign * F.col("ret")).alias("signed_return"))


def uncertainty_buckets(df: DataFrame) -> DataFrame:
    """(bucket, n, mae, median_sigma): cut at the values with index int(q * (n - 1)) of the sorted sigmas, q = .33, .66.

    Buckets are stretches of the order of sigmas, so their medians are read at places of it.
    """
    by_value = with_before(df.groupBy("sigma").agg(F.count(F.lit(1)).alias("k")), "sigma", "k")
    by_value = by_value.withColumn("upto", F.col("before") + F.col("k"))
    counted = by_value.crossJoin(F.broadcast(df.agg(F.count("sigma").alias("n"))))  # one row
    cut = lambda q: F.min(F.when(F.col("upto") > F.floor(q * (F.col("n") - 1)), F.col("sigma")))
    cuts = counted.agg(cut(0.33).alias("low"), cut(0.66).alias("high"))
    bucket = F.when(F.col("sigma") <= F.col("low"), "low").when(F.col("sigma") <= F.col("high"), "medium").otherwise("high")
    named = by_value.crossJoin(F.broadcast(cuts)).withColumn("bucket", bucket)  # one row
    sizes = named.groupBy("bucket").agg(F.min("before").alias("first"), F.sum("k").alias("size"))
    at = lambda half: F.min(F.when(F.col("upto") > F.col("first") + half(((F.col("size") - 1) / 2)), F.col("sigma")))
    medians = named.join(F.broadcast(sizes), "bucket").groupBy("bucket").agg(((at(F.floor) + at(F.ceil)) / 2).alias("median_sigma"))  # three rows
    rows = df.crossJoin(F.broadcast(cuts)).groupBy(bucket.alias("bucket"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("mu") - F.col("ret"))).alias("mae")).join(medians, "bucket")


def reliability(df: DataFrame, least: float = 0.7) -> DataFrame:
    hit = ((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double")
    return df.where(F.greatest(F.col("p"), 1 - F.col("p")) >= least).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("hit_rate"))


def dropout_summary(passes: DataFrame) -> DataFrame:
    """From (pass, row_id, prob): mean spread and entropy over rows, and the share of rows with a spread of 0.10 or more."""
    rows = passes.groupBy("row_id").agg(F.stddev_pop("prob").alias("std"), F.avg("prob").alias("m"))
    q = F.least(F.greatest("m", F.lit(1e-8)), F.lit(1 - 1e-8))
    entropy = -(q * F.ln(q) + (1 - q) * F.ln(1 - q))
    return rows.agg(F.avg("std").alias("mean_std"), F.avg(entropy).alias("mean_entropy"), F.avg((F.col("std") >= 0.10).cast("double")).alias("high_share"))


def spearman_by_ts(df: DataFrame, a: str, b: str, least: int = 4) -> DataFrame:
    """(ts, n, ic): rank correlation with tied ranks averaged, where a timestamp has `least` rows."""
    x = Window.partitionBy("ts")
    mean_rank = lambda c: F.rank().over(x.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("ts", c)) - 1) / 2.0
    ranks = df.select("ts", mean_rank(a).alias("ra"), mean_rank(b).alias("rb"))
    constant = (F.min("ra") == F.max("ra")) | (F.min("rb") == F.max("rb"))
    out = ranks.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.when(constant, None).otherwise(F.corr("ra", "rb")).alias("ic"))
    return out.where(F.col("n") >= least)


def top_bottom_spread(df: DataFrame, score: str, ret: str, share: float = 0.1, least: int = 4) -> DataFrame:
    """(ts, spread): mean return of the top k by score minus the bottom k, k = max(1, int(share * n))."""
    x = Window.partitionBy("ts")
    df = df.withColumns(
        {"n": F.count(F.lit(1)).over(x), "up": F.row_number().over(x.orderBy(F.col(score), "ticker")), "down": F.row_number().over(x.orderBy(F.col(score).desc(), "ticker"))}
    ).where(F.col("n") >= least)
    k = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    mean = lambda test: F.avg(F.when(test, F.col(ret)))
    return df.groupBy("ts").agg((mean(F.col("down") <= k) - mean(F.col("up") <= k)).alias("spread"))


def action_scores(df: DataFrame, sigma_floor: float = 0.1) -> DataFrame:
    """score: sign(p - 0.5) * mu / max(sigma, floor), standardised over the whole set (one broadcast row); 2p - 1 if constant."""
    df = df.withColumn("raw", F.signum(F.col("p") - 0.5) * F.col("mu") / F.greatest("sigma", F.lit(sigma_floor)))
    row = df.agg(F.avg("raw").alias("m"), F.stddev_pop("raw").alias("s"))
    df = df.crossJoin(F.broadcast(row))
    return df.withColumn("score", F.when(F.col("s") > 1e-12, (F.col("raw") - F.col("m")) / F.when(F.col("s") > 1e-12, F.col("s"))).otherwise(2 * (F.col("p") - 0.5))).drop("raw", "m", "s")


def event_composition(df: DataFrame) -> DataFrame:
    """df (p_event, p_direction) with p_up, p_down, p_neutral, confidence and p, the chance of up given a move; 0.5 where there's none."""
    part = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    df = df.withColumns(
        {
            "p_up": part(F.col("p_event") * F.col("p_direction")), "p_down": part(F.col("p_event") * (1 - F.col("p_direction"))), "p_neutral": part(1 - F.col("p_event")),
        }
    )
    return directional_share(df)


def directional_share(df: DataFrame) -> DataFrame:
    """df (p_up, p_down) with confidence, the larger of them, and p, up's share of both; 0.5 where they add up to nothing."""
    both = F.col("p_up") + F.col("p_down")
    return df.withColumns({"confidence": F.greatest("p_up", "p_down"), "p": F.when(both > 1e-8, F.col("p_up") / F.when(both > 1e-8, both)).otherwise(0.5)})


def directional_rows(df: DataFrame, label: str = "label3") -> DataFrame:
    """The rows whose three-class label (0 down, 1 neutral, 2 up) isn't neutral, with label 1 for up and 0 for down."""
    return df.where(F.col(label) != 1).withColumn("label", (F.col(label) == 2).cast("int"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """(value, name): the average rank of each distinct value among all rows."""
    by_value = with_before(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")), value)
    return by_value.select(value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))


def global_spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and ic, the rank correlation over all rows with tied ranks averaged; null if a side is constant."""
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    ranks = rows.join(average_ranks(rows, "a", "ra"), "a").join(average_ranks(rows, "b", "rb"), "b")
    constant = (F.min("ra") == F.max("ra")) | (F.min("rb") == F.max("rb"))
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.when(constant, None).otherwise(F.corr("ra", "rb")).alias("ic"))


def event_summary(df: DataFrame, label: str = "event_label", p: str = "p_event") -> DataFrame:
    """One row: count, prevalence of the event, mean event probability."""
    return df.agg(F.count(label).alias("sample_count"), F.avg(F.col(label).cast("double")).alias("event_prevalence"), F.avg(p).alias("mean_p_event"))


def checkpoint_score(df: DataFrame, least: int = 200) -> DataFrame:
    """One row: the AUC where `least` rows or more have a label and it is defined, else the accuracy."""
    row = df.agg(F.count("label").alias("n"), F.avg(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("accuracy"))
    return row.crossJoin(auc(df)).select("n", F.when((F.col("n") >= least) & F.col("auc").isNotNull(), F.col("auc")).otherwise(F.col("accuracy")).alias("score"))  # one row each
