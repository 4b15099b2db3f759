"""The library's operators as queries over the benchmark tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise import adapters
from tracewise.adapters import EVENTS_SQL, FPS, TRACES_SQL
from tracewise.functions.arrays import simpson
from tracewise.functions.formats import regression_symbol, significance_symbol
from tracewise.functions.keys import canonical_key
from tracewise.operators import detect as D
from tracewise.operators import display, grouping, latency, metrics, modulation, selection, signal, stats, validation
from tracewise.operators.recipes import regenerate, side_of
from tracewise.operators.windows import events_in_epoch, events_in_window
from tracewise.plans.lineage import checkpointed
from tracewise.plans.specs import EventTableParams
from tracewise.sources import nested
from tracewise.sources.event_files import FREQUENCY_GLOBS, SUFFIXES, read_event_folder, read_frequencies
from tracewise.sources.tables import read_manifest, read_table, write_bucketed, write_tables
from tracewise.streaming.detect import stacked_stream
from tracewise.streaming.replay import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Windows of the queries: onsets of the benchmark events lie between 0 and 10 seconds.
EARLY, OVERRIDES = (5.1, 6.1), {"passive_axons": (5.0, 6.5), "NO_DREADDs": (4.0, 7.5)}
#: Trace settings that find events in the benchmark's noise.
LOOSE, FEW = {"sd": 0.5, "min_samples": 4}, {"sd": 1.0, "min_samples": 2}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, by default its function's, with its SQL."""

    def put(make: Query) -> Query:
        QUERIES[name or make.__name__] = make
        if sql:
            ORACLES[name or make.__name__] = sql
        return make

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.events(spark, sf)


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


ALL = ("peak", "ev_onset", "peak_time", "ev_offset", "ev_duration", "integral")

# Windows and counts --------------------------------------------------------------------------------------------------


@query(f"WITH {EVENTS_SQL} SELECT row_ord, protocol, k0, k1, round(ev_onset, 6) AS ev_onset FROM ev WHERE ev_onset > 5.1 AND ev_onset < 6.1", "events_in_window")
def window_events(spark, sf):
    return rounded(events_in_window(_events(spark, sf), EARLY).select("row_ord", "protocol", "k0", "k1", "ev_onset"))


@query(f"""WITH {EVENTS_SQL} SELECT row_ord, protocol, round(ev_onset, 6) AS ev_onset FROM ev
WHERE ev_onset > CASE protocol WHEN 'passive_axons' THEN 5.0 WHEN 'NO_DREADDs' THEN 4.0 ELSE 5.1 END
  AND ev_onset < CASE protocol WHEN 'passive_axons' THEN 6.5 WHEN 'NO_DREADDs' THEN 7.5 ELSE 6.1 END""")
def epoch_window_override(spark, sf):
    return rounded(events_in_epoch(_events(spark, sf), EARLY, OVERRIDES).select("row_ord", "protocol", "ev_onset"))


WHITE_SQL = """wl AS (
  SELECT * REPLACE (CASE WHEN protocol IN ('task_axons', 'NO_DREADDs') AND outcome IN ('cCATCH', 'nCATCH') THEN 'CATCH'
                         WHEN protocol LIKE '%passive%' THEN history ELSE outcome END AS outcome)
  FROM ev WHERE protocol LIKE '%passive%'
     OR (protocol IN ('task_axons', 'NO_DREADDs') AND outcome IN ('CR', 'miss', 'cHIT', 'nHIT', 'HIT', 'CATCH', 'cCATCH', 'nCATCH'))
     OR (protocol LIKE '%dendrites%' AND outcome IN ('CR', 'miss', 'cHIT', 'nHIT', 'HIT', 'nCATCH', 'cCATCH'))
)"""
POOL_SQL = """po AS (
  SELECT * FROM wl UNION ALL SELECT * REPLACE ('HIT' AS outcome) FROM wl WHERE outcome LIKE '%HIT%'
  UNION ALL SELECT * REPLACE ('Rew' AS outcome) FROM wl WHERE outcome LIKE '%Rew%'
)"""


@query(f"WITH {EVENTS_SQL}, {WHITE_SQL} SELECT protocol, outcome, count(*) AS n FROM wl GROUP BY ALL")
def outcome_whitelist(spark, sf):
    return metrics.whitelisted(_events(spark, sf), "reward").groupBy("protocol", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL}, {WHITE_SQL}, {POOL_SQL} SELECT protocol, outcome, count(*) AS n, round(sum(peak), 2) AS peaks FROM po GROUP BY ALL")
def pooled_outcomes(spark, sf):
    rows = metrics.pooled_outcomes(metrics.whitelisted(_events(spark, sf), "reward"), "reward")
    return rows.groupBy("protocol", "outcome").agg(F.count("*").alias("n"), F.round(F.sum("peak"), 2).alias("peaks"))


COUNTS_SQL = "tc AS (SELECT protocol, k0 AS session, outcome AS ttype, count(DISTINCT trial) AS n FROM ev GROUP BY ALL)"


@query(f"WITH {EVENTS_SQL}, {COUNTS_SQL} SELECT * FROM tc")
def trial_counts(spark, sf):
    return adapters.trial_counts(_events(spark, sf))


@query("""WITH rw AS (
  SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'HIT' WHEN 'signup' THEN 'CATCH' WHEN 'click' THEN 'None' WHEN 'error' THEN 'resp early' ELSE 'FA' END AS ttype,
         CASE event_type WHEN 'purchase' THEN 'cRew' WHEN 'signup' THEN 'nRew' WHEN 'click' THEN 'cStim' ELSE 'nStim' END AS history FROM events
), fl AS (
  SELECT 's' || (user_id % 3) AS session, ttype, user_id % 2 AS part, count(*) AS n, max(event_id) AS ord FROM rw WHERE ttype <> 'None' AND ttype NOT LIKE '%resp%' GROUP BY ALL
), la AS (SELECT session, ttype, arg_max(n, ord) AS n FROM fl GROUP BY ALL)
SELECT 'task_axons' AS protocol, NULL::VARCHAR AS td, session, ttype, n FROM la
UNION ALL SELECT 'NO_DREADDs', NULL, 'x' || session, ttype, n FROM la
UNION ALL SELECT CASE WHEN user_id % 2 = 0 THEN 'passive_axons' ELSE 'passive_dendrites' END, NULL, 'RGECO_GCaMP_Batch1_m' || (user_id % 3), history, count(*) FROM rw WHERE user_id % 5 > 0 GROUP BY ALL
UNION ALL SELECT 'passive_axons', NULL, 'GCaMP_POm_Batch3_n' || (user_id % 3) || '_FOV' || (user_id % 2), history, count(*) FROM rw WHERE user_id % 5 > 0 GROUP BY ALL
UNION ALL SELECT 'task_dendrites' || CASE WHEN user_id % 4 < 2 THEN ' (pre-CNO)' ELSE ' (post-CNO)' END, 'TD' || (user_id % 4), 'mouse' || (user_id % 3), ttype, count(*) FROM rw WHERE user_id % 4 IN (0, 2, 3) GROUP BY ALL
UNION ALL SELECT 'control_dendrites' || CASE WHEN user_id % 4 < 2 THEN ' (pre-CNO)' ELSE ' (post-CNO)' END, 'TD' || (user_id % 4), 'mouse' || (user_id % 3), ttype, count(*) FROM rw WHERE user_id % 4 IN (1, 2, 3) GROUP BY ALL""")
def trial_counts_of_tables(spark, sf):
    return grouping.trial_counts(adapters.count_tables(spark, sf))


def _totals(spark, sf, alignment: str, legacy: bool) -> DataFrame:
    rows = _events(spark, sf)
    label = F.when(F.col("protocol").contains("passive"), F.col("history")).otherwise(F.col("outcome"))
    counts = adapters.trial_counts(rows.withColumn("label", label), "label")
    return grouping.trial_totals(counts, alignment, legacy)


def _totals_sql(alignment: str, legacy: bool) -> str:
    first, second = ("Rew", "Stim") if alignment == "reward" else ("Stim", "Rew")
    t, r = ("ttype LIKE '%HIT%'", "ttype NOT LIKE '%HIT%'")
    if alignment == "stimulus":
        t = "(ttype LIKE '%HIT%' OR ttype LIKE '%miss%')"
        r = t if legacy else "(ttype LIKE '%FA%' OR ttype LIKE '%CATCH%')"
    return f"""WITH {EVENTS_SQL}, c AS (
  SELECT protocol, k0, CASE WHEN protocol LIKE '%passive%' THEN history ELSE outcome END AS ttype, count(DISTINCT trial) AS n FROM ev GROUP BY ALL
)
SELECT protocol,
  coalesce(sum(n) FILTER (WHERE CASE WHEN protocol IN ('task_axons', 'NO_DREADDs') THEN ttype = 'HIT' WHEN protocol LIKE '%passive%' THEN ttype LIKE '%{first}%' ELSE {t} END), 0)::BIGINT AS n_target,
  coalesce(sum(n) FILTER (WHERE CASE WHEN protocol IN ('task_axons', 'NO_DREADDs') THEN ttype IN ('FA', 'CATCH') WHEN protocol LIKE '%passive%' THEN ttype LIKE '%{second}%' ELSE {r} END), 0)::BIGINT AS n_reference
FROM c GROUP BY protocol"""


@query(_totals_sql("reward", True))
def trial_totals_reward(spark, sf):
    return _totals(spark, sf, "reward", True)


@query(_totals_sql("stimulus", True))
def trial_totals_stimulus_legacy(spark, sf):
    return _totals(spark, sf, "stimulus", True)


@query(_totals_sql("stimulus", False))
def trial_totals_stimulus_corrected(spark, sf):
    return _totals(spark, sf, "stimulus", False)


# Modulation ----------------------------------------------------------------------------------------------------------

SIDES_SQL = """sd AS (
  SELECT protocol, k0, count(DISTINCT trial) FILTER (WHERE side = 'target') AS n_target,
         count(DISTINCT trial) FILTER (WHERE side = 'reference') AS n_reference FROM ev GROUP BY ALL
)"""
MI_SQL = f"""WITH {EVENTS_SQL}, {SIDES_SQL}, ct AS (
  SELECT protocol, k0, k1, count(*) FILTER (WHERE side = 'target') AS t, count(*) FILTER (WHERE side = 'reference') AS r
  FROM ev WHERE ev_onset > 5.1 AND ev_onset < 6.1 GROUP BY ALL HAVING count(*) FILTER (WHERE side = 'target') > 0
), mi AS (
  SELECT protocol, k0, k1, CASE WHEN r = 0 THEN least(t / n_target, 1.0)
         ELSE (t / n_target - r / n_reference) / (t / n_target + r / n_reference) END AS mi
  FROM ct JOIN sd USING (protocol, k0)
)"""


def _sessions(events: DataFrame) -> DataFrame:
    of = lambda side: F.count_if(F.col("side") == side)
    trials = events.select("protocol", "k0", "side", "trial").distinct()
    return trials.groupBy("protocol", "k0").agg(of("target").alias("n_target"), of("reference").alias("n_reference"))


def _indices(spark, sf) -> DataFrame:
    rows = _events(spark, sf)
    units = rows.select("protocol", "k0", "k1").distinct()
    return modulation.modulation_index(events_in_window(rows, EARLY), units.join(_sessions(rows), ["protocol", "k0"]))


@query(MI_SQL + " SELECT protocol, k0, k1, round(mi, 6) AS mi FROM mi")
def modulation_index(spark, sf):
    return rounded(_indices(spark, sf))


def _modulated_sql(cutoff: str) -> str:
    return MI_SQL + f", cu AS (SELECT protocol, {cutoff} AS cutoff FROM mi GROUP BY protocol), md AS (SELECT mi.* FROM mi JOIN cu USING (protocol) WHERE mi > cutoff)"


MEDIAN_SQL = _modulated_sql("median(mi)")


@query(_modulated_sql("avg(mi)") + " SELECT protocol, k0, k1, round(mi, 6) AS mi FROM md")
def modulated_rois_mean(spark, sf):
    return rounded(modulation.modulated_units(_indices(spark, sf), "mean"))


@query(MEDIAN_SQL + " SELECT protocol, k0, k1, round(mi, 6) AS mi FROM md")
def modulated_rois_median(spark, sf):
    return rounded(modulation.modulated_units(_indices(spark, sf), "median"))


@query(_modulated_sql("0.5 * stddev_pop(mi)") + " SELECT protocol, k0, k1, round(mi, 6) AS mi FROM md")
def modulated_rois_half_std(spark, sf):
    return rounded(modulation.modulated_units(_indices(spark, sf), "half_std"))


@query(MI_SQL + " SELECT protocol, round(median(mi), 9) AS median, round(quantile_cont(mi, 0.9), 9) AS upper FROM mi GROUP BY protocol")
def index_quantiles(spark, sf):
    """Cutoffs by narrowing histograms, as protocols of any number of units get them."""
    indices = checkpointed(_indices(spark, sf))
    median, upper = (selection.narrowed(indices, ["protocol"], "mi", q, name) for q, name in ((0.5, "median"), (0.9, "upper")))
    return rounded(median.join(upper, "protocol"), 9)


@query(MEDIAN_SQL + """ SELECT protocol, n_modulated, n_total, format('{:.1f}', n_modulated / n_total * 100)::DOUBLE AS percent
FROM (SELECT protocol, count(*) AS n_modulated FROM md GROUP BY protocol)
JOIN (SELECT protocol, count(*) AS n_total FROM (SELECT DISTINCT protocol, k0, k1 FROM ev) GROUP BY protocol) USING (protocol)""")
def modulation_proportions(spark, sf):
    units = _events(spark, sf).select("protocol", "k0", "k1").distinct()
    return modulation.modulation_proportions(modulation.modulated_units(_indices(spark, sf), "median"), units)


# Metrics by unit -----------------------------------------------------------------------------------------------------

METRICS_SQL = f"""{EVENTS_SQL}, {WHITE_SQL}, {POOL_SQL}, pc AS (SELECT protocol, k0, outcome, count(DISTINCT trial) AS n FROM po GROUP BY ALL),
g AS (
  SELECT side, protocol, outcome, k0, k1, {', '.join(f'avg({m}) AS {m}' for m in ALL)}, count(*) AS n_events FROM po
  WHERE ev_onset > 5.1 AND ev_onset < 6.1 AND outcome IN ('cHIT', 'nHIT', 'HIT', 'Rew', 'cRew', 'nRew', 'CATCH') GROUP BY ALL
), m AS (
  SELECT g.* EXCLUDE (side, n_events), n_events / n AS rate FROM g JOIN pc USING (protocol, k0, outcome)
  WHERE side = 'reference' OR NOT EXISTS (SELECT 1 FROM g h WHERE h.side = 'reference' AND h.protocol = g.protocol AND h.outcome = g.outcome)
)"""


def _prepared(spark, sf) -> DataFrame:
    return metrics.pooled_outcomes(metrics.whitelisted(_events(spark, sf), "reward"), "reward")


def _denominators(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("protocol", F.col("k0").alias("session"), F.col("outcome").alias("ttype")).agg(F.count_distinct("trial").alias("n"))
    return metrics.rate_denominators(counts, "reward")


def _metrics(spark, sf) -> DataFrame:
    rows = _prepared(spark, sf)
    return metrics.metrics_by_unit(events_in_window(rows, EARLY), _denominators(rows), "reward")


METRIC_COLUMNS = f"protocol, outcome, k0, k1, {_r(*ALL, 'rate')}"


@query(f"WITH {METRICS_SQL} SELECT {METRIC_COLUMNS} FROM m")
def roi_metrics_active(spark, sf):
    return rounded(_metrics(spark, sf))


@query(MEDIAN_SQL + ", " + METRICS_SQL.removeprefix(EVENTS_SQL + ", ") + f" SELECT {METRIC_COLUMNS} FROM m WHERE (protocol, k0, k1) IN (SELECT (protocol, k0, k1) FROM md) OR protocol NOT IN (SELECT protocol FROM md)")
def roi_metrics_modulated(spark, sf):
    return rounded(metrics.modulated_only(_metrics(spark, sf), modulation.modulated_units(_indices(spark, sf), "median")))


@query(f"""WITH {METRICS_SQL}, w AS (
  SELECT protocol, o.outcome, k0, k1 FROM (SELECT DISTINCT protocol, k0, k1 FROM ev) u JOIN (SELECT DISTINCT protocol, outcome FROM m) o USING (protocol)
  EXCEPT SELECT protocol, outcome, k0, k1 FROM m
)
SELECT {METRIC_COLUMNS} FROM m UNION ALL
SELECT protocol, outcome, k0, k1, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN n > 0 THEN 0.0 END FROM w LEFT JOIN pc USING (protocol, k0, outcome)""")
def roi_metrics_all(spark, sf):
    rows = _prepared(spark, sf)
    universe = _events(spark, sf).select("protocol", "k0", "k1").distinct()
    return rounded(metrics.fill_inactive(_metrics(spark, sf), universe, _denominators(rows)))


@query(f"WITH {METRICS_SQL} SELECT protocol, outcome, k0, k1, round(ev_onset, 6) AS value FROM m")
def comparison_values(spark, sf):
    return rounded(metrics.comparison_values(_metrics(spark, sf), "ev_onset"))


def _normalized_sql(metric: str, offset: float) -> str:
    return f"""WITH {METRICS_SQL} SELECT protocol, outcome, k0, k1, round(({metric} - {offset}) / (SELECT avg({metric} - {offset}) FROM m WHERE protocol = 'NO_DREADDs' AND outcome = 'HIT'), 6) AS value
FROM m WHERE protocol = 'task_axons' AND outcome = 'cHIT'"""


def _normalized(spark, sf, metric: str, offset: float) -> DataFrame:
    values = metrics.comparison_values(_metrics(spark, sf), metric)
    return rounded(metrics.normalized(values, ("task_axons", "cHIT"), ("NO_DREADDs", "HIT"), offset))


@query(_normalized_sql("rate", 0.0))
def normalized_ratio(spark, sf):
    return _normalized(spark, sf, "rate", 0.0)


@query(_normalized_sql("ev_onset", 5.0))
def normalized_offset(spark, sf):
    return _normalized(spark, sf, "ev_onset", 5.0)


# Tests ---------------------------------------------------------------------------------------------------------------

PAIRS = [("hits", "task_axons", "cHIT", "task_axons", "nHIT"), ("across", "task_axons", "HIT", "NO_DREADDs", "HIT"), ("passive", "passive_axons", "cRew", "passive_axons", "nRew")]
VALUES_SQL = f"""{METRICS_SQL}, sp AS (SELECT * FROM (VALUES {', '.join(str(p) for p in PAIRS)}) t(name, ap, ao, bp, bo)),
sa AS (
  SELECT name, 'a' AS g, k0, k1, peak AS v FROM m JOIN sp ON protocol = ap AND outcome = ao
  UNION ALL SELECT name, 'b', k0, k1, peak FROM m JOIN sp ON protocol = bp AND outcome = bo
)"""
SIDE_SQL = """count(v) FILTER (WHERE g = 'a') AS n_a, count(v) FILTER (WHERE g = 'b') AS n_b, avg(v) FILTER (WHERE g = 'a') AS mean_a, avg(v) FILTER (WHERE g = 'b') AS mean_b,
  var_samp(v) FILTER (WHERE g = 'a') AS va, var_samp(v) FILTER (WHERE g = 'b') AS vb"""
# The tail of Student's t for whole degrees of freedom, as a finite sum over powers of a cosine.
EXACT_TAIL_SQL = """(1 - CASE WHEN nu % 2 = 0 THEN sin(th) * list_sum(list_transform(range(0, nu // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * cos(th) ** (2 * k)))
  ELSE 2 / pi() * (th + CASE WHEN nu > 1 THEN sin(th) * list_sum(list_transform(range(0, (nu - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * cos(th) ** (2 * k + 1))) ELSE 0 END) END)"""
TAIL_SQL = f"round({EXACT_TAIL_SQL}, 6) AS p_value"
# The same for any degrees of freedom nu: Simpson's rule with 400 steps over the density in terms of an angle.
WELCH_TAIL_SQL = """1 - exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(pi()) * 2 * th / 1200
  * list_sum(list_transform(range(0, 401), lambda k: CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * cos(k / 400 * th) ** (nu - 1)))"""
# Both tails of the normal distribution beyond z, from the series of the error function with positive terms.
NORMAL_SQL = """greatest(0, 1 - sqrt(2 / pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 200), lambda k:
  exp((2 * k + 1) * ln(greatest(z, 1e-300)) - k * ln(2) - lgamma(k + 1.5) + lgamma(1.5)))))"""
TESTS_SQL = f"""{VALUES_SQL}, s AS (SELECT name, {SIDE_SQL} FROM sa GROUP BY name),
pr AS (
  SELECT name, k0, k1, avg(v) FILTER (WHERE g = 'a') AS a, avg(v) FILTER (WHERE g = 'b') AS b FROM sa GROUP BY ALL
  HAVING count(v) FILTER (WHERE g = 'a') > 0 AND count(v) FILTER (WHERE g = 'b') > 0
), ps AS (
  SELECT name, count(*) AS n_a, count(*) AS n_b, avg(a) AS mean_a, avg(b) AS mean_b, var_samp(a) AS va, var_samp(b) AS vb,
         avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t, count(*) - 1 AS nu FROM pr GROUP BY name
), student AS (
  SELECT *, {EXACT_TAIL_SQL} AS p_value FROM (
    SELECT *, atan(abs(t) / sqrt(nu)) AS th FROM (
      SELECT *, (mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)) AS t, n_a + n_b - 2 AS nu FROM s))
), welch AS (
  SELECT *, {WELCH_TAIL_SQL} AS p_value FROM (
    SELECT *, atan(abs(t) / sqrt(nu)) AS th FROM (
      SELECT *, (mean_a - mean_b) / sqrt(va / n_a + vb / n_b) AS t,
             (va / n_a + vb / n_b) ** 2 / ((va / n_a) ** 2 / (n_a - 1) + (vb / n_b) ** 2 / (n_b - 1)) AS nu FROM s))
), paired AS (SELECT *, {EXACT_TAIL_SQL} AS p_value FROM (SELECT *, atan(abs(t) / sqrt(nu)) AS th FROM ps)),
rk AS (
  SELECT name, g, rank() OVER (PARTITION BY name ORDER BY round(v, 12)) + (count(*) OVER (PARTITION BY name, round(v, 12)) - 1) / 2 AS r FROM sa
), us AS (
  SELECT name, sum(r) FILTER (WHERE g = 'a') - count(*) FILTER (WHERE g = 'a') * (count(*) FILTER (WHERE g = 'a') + 1) / 2 AS u FROM rk GROUP BY name
), tu AS (SELECT name, sum(n ** 3 - n) AS ties FROM (SELECT name, r, count(*) AS n FROM rk GROUP BY name, r) GROUP BY name),
ranked AS (SELECT *, greatest(u, n_a * n_b - u) AS high, least(n_a, n_b) AS small, n_a + n_b AS pool FROM s JOIN us USING (name) JOIN tu USING (name)),
-- Samples of the smaller size from all ranks, by their sum: counted rank by rank where the null is counted out.
draws(name, upto, small, pool, i, k, total, ways) AS (
  SELECT name, high, small, pool, 0, 0, 0, 1::DOUBLE FROM ranked WHERE small <= 8 AND ties = 0
  UNION ALL
  SELECT name, upto, small, pool, i, k, total, sum(ways) FROM (
    SELECT d.name, d.upto, d.small, d.pool, d.i + 1 AS i, d.k + o.hit AS k, d.total + o.hit * (d.i + 1) AS total, d.ways FROM draws d, (VALUES (0), (1)) o(hit)
    WHERE d.i < d.pool AND d.k + o.hit <= d.small
  ) GROUP BY name, upto, small, pool, i, k, total
), counted AS (
  SELECT name, least(1, 2 * coalesce(sum(ways) FILTER (WHERE total - small * (small + 1) / 2 >= ceil(upto)), 0) / sum(ways)) AS p FROM draws WHERE i = pool AND k = small GROUP BY name
), ranksum AS (
  SELECT *, coalesce(p, least(1, {NORMAL_SQL})) AS p_value FROM (
    SELECT ranked.*, p, abs(high - n_a * n_b / 2 - 0.5) / sqrt(n_a * n_b / 12 * (pool + 1 - ties / (pool * (pool - 1)))) AS z FROM ranked LEFT JOIN counted USING (name))
), d AS (SELECT name, round(a - b, 12) AS d FROM pr),
dk AS (SELECT name, d, rank() OVER (PARTITION BY name ORDER BY abs(d)) + (count(*) OVER (PARTITION BY name, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0),
ws AS (SELECT name, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w, count(*) AS kept FROM dk GROUP BY name),
tw AS (SELECT name, sum(n ** 3 - n) AS ties FROM (SELECT name, r, count(*) AS n FROM dk GROUP BY name, r) GROUP BY name),
signs AS (SELECT ps.*, w, kept, ties, n_a - kept AS zeros FROM ps JOIN ws USING (name) JOIN tw USING (name)),
flips(name, upto, kept, i, total, ways) AS (
  SELECT name, w, kept, 0, 0, 1::DOUBLE FROM signs WHERE kept <= 50 AND zeros = 0 AND ties = 0
  UNION ALL
  SELECT name, upto, kept, i, total, sum(ways) FROM (
    SELECT f.name, f.upto, f.kept, f.i + 1 AS i, f.total + o.hit * (f.i + 1) AS total, f.ways FROM flips f, (VALUES (0), (1)) o(hit) WHERE f.i < f.kept
  ) GROUP BY name, upto, kept, i, total
), flipped AS (SELECT name, least(1, 2 * sum(ways) FILTER (WHERE total <= floor(upto)) / sum(ways)) AS p FROM flips WHERE i = kept GROUP BY name),
signed AS (
  SELECT *, coalesce(p, {NORMAL_SQL}) AS p_value FROM (
    SELECT signs.*, p, abs(w - kept * (kept + 1) / 4) / sqrt(kept * (kept + 1) * (2 * kept + 1) / 24 - ties / 48) AS z FROM signs LEFT JOIN flipped USING (name))
)"""
OUT_SQL = "n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(sqrt(va / n_a), 6) AS sem_a, round(sqrt(vb / n_b), 6) AS sem_b"
#: Of each test, its table in ``TESTS_SQL`` and the statistic's column.
TEST_TABLES = {"student_t": ("student", "t"), "welch_t": ("welch", "t"), "mannwhitney": ("ranksum", "u"), "wilcoxon": ("signed", "w"), "paired_t": ("paired", "t")}


def _test_sql(test: str, more: str = "") -> str:
    held, statistic = TEST_TABLES[test]
    return f"SELECT name, round({statistic}, 6) AS statistic, round(p_value, 6) AS p_value, {OUT_SQL}{more} FROM {held}"


def _comparisons(spark: SparkSession, test: str | None = None) -> DataFrame:
    rows = [(n, t, *p, 0.5) for n, *p in PAIRS for t in ([test] if test else stats.TESTS)]
    return spark.createDataFrame(rows, "name string, test string, a_protocol string, a_outcome string, b_protocol string, b_outcome string, p_threshold double")


def _samples(spark, sf, comparisons: DataFrame) -> DataFrame:
    return stats.samples(metrics.comparison_values(_metrics(spark, sf), "peak"), comparisons)


def _compared(spark, sf, test: str) -> DataFrame:
    return rounded(stats.run_test(_samples(spark, sf, _comparisons(spark, test)), test).drop("test"))


@query(f"WITH RECURSIVE {TESTS_SQL} {_test_sql('student_t')}")
def compare_student_t(spark, sf):
    return _compared(spark, sf, "student_t")


@query(f"WITH RECURSIVE {TESTS_SQL} {_test_sql('welch_t')}")
def compare_welch_t(spark, sf):
    return _compared(spark, sf, "welch_t")


@query(f"WITH RECURSIVE {TESTS_SQL} {_test_sql('paired_t')}")
def compare_paired_t(spark, sf):
    return _compared(spark, sf, "paired_t")


@query(f"WITH RECURSIVE {TESTS_SQL} {_test_sql('mannwhitney')}")
def compare_mannwhitney(spark, sf):
    return _compared(spark, sf, "mannwhitney")


@query(f"WITH RECURSIVE {TESTS_SQL} {_test_sql('wilcoxon')}")
def compare_wilcoxon(spark, sf):
    return _compared(spark, sf, "wilcoxon")


SYMBOL_SQL = "CASE WHEN p < 0.0001 THEN '****' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE"


SHOWN_SQL = r"regexp_replace(format('{:.3f}', p), '(\.\d+?)0+$', '\1')"


@query(
    f"WITH RECURSIVE {TESTS_SQL} SELECT * EXCLUDE (p), p < 0.5 AS passed, {SYMBOL_SQL} {SHOWN_SQL} END AS symbol FROM ("
    + " UNION ALL ".join(_test_sql(t, f", '{t}' AS test, p_value AS p") for t in TEST_TABLES)
    + ")"
)
def run_comparisons_gate(spark, sf):
    comparisons = _comparisons(spark)
    return rounded(stats.run_comparisons(_samples(spark, sf, comparisons), comparisons))


@query(f"WITH p AS (SELECT event_id, event_id % 97 / 970 * (event_id % 7) / 70 AS p FROM events) SELECT event_id, {SYMBOL_SQL} {SHOWN_SQL} END AS symbol, {SYMBOL_SQL} 'n.s' END AS slope FROM p")
def significance_symbols(spark, sf):
    p = F.col("event_id") % 97 / 970 * (F.col("event_id") % 7) / 70
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", p.alias("p"))
    return rows.select("event_id", significance_symbol(F.col("p")).alias("symbol"), regression_symbol(F.col("p")).alias("slope"))


# Traces --------------------------------------------------------------------------------------------------------------

BASE_SQL = TRACES_SQL + """, ba AS (SELECT *, [100 + 10 * x FOR x IN y] AS raw FROM tr), f AS (
  SELECT *, median_of AS f0raw FROM (SELECT *, list_median(raw[20:29]) AS median_of FROM ba)
), sm AS (
  SELECT *, quantile_cont(f0raw, 0.5) OVER (PARTITION BY roi ORDER BY row_ord ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS f0 FROM f
)"""


def _raw(spark, sf) -> DataFrame:
    return adapters.traces(spark, sf).withColumn("y", F.transform("y", lambda x: 100 + 10 * x))


@query(f"WITH {BASE_SQL} SELECT roi, trial, round(f0, 6) AS f0 FROM sm")
def f0_rolling_median(spark, sf):
    return rounded(signal.with_baseline(_raw(spark, sf), FPS).select("roi", "trial", "f0"))


@query(f"WITH {BASE_SQL} SELECT roi, trial, i::INT AS frame, round((raw[i + 1] - f0) / f0, 6) AS v FROM (SELECT *, unnest(range(64)) AS i FROM sm)")
def dff(spark, sf):
    made = signal.dff(_raw(spark, sf), FPS)
    return rounded(made.select("roi", "trial", F.posexplode("y").alias("frame", "v")))


def _bucketed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return write_bucketed(rows, f"traces_{uuid.uuid4().hex}", spark.sparkContext.defaultParallelism)


@query(ORACLES["f0_rolling_median"])
def f0_in_blocks(spark, sf):
    """The same, by blocks of 16 trials of a unit."""
    return rounded(signal.with_baseline(_raw(spark, sf), FPS, block=16).select("roi", "trial", "f0"))


@query(ORACLES["dff"])
def dff_in_place(spark, sf):
    """The same over traces in buckets of units, none of which is moved."""
    made = signal.dff(_bucketed(spark, _raw(spark, sf)), FPS, in_place=True)
    return rounded(made.select("roi", "trial", F.posexplode("y").alias("frame", "v")))


@query(f"WITH {TRACES_SQL} SELECT roi, round(2 * stddev_pop(v), 6) AS threshold FROM (SELECT roi, unnest(y[21:30]) AS v FROM tr) GROUP BY roi")
def baseline_threshold(spark, sf):
    return rounded(D.thresholds(adapters.traces(spark, sf), FPS, (2.0, 3.0), 2.0).select("roi", "threshold"))


def _detect_sql(
    stack: str, sd: float, least: int, low: int = 21, high: int = 30, where: str = "true", base: int = 0, having: str = "true", traces: str = TRACES_SQL, frames: int = 64, fps: float = 10
) -> str:
    weight = """CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 0.5 ELSE
      (CASE WHEN j >= odd THEN 0 WHEN j = 0 OR j = odd - 1 THEN 1 / 3 WHEN j % 2 = 1 THEN 4 / 3 ELSE 2 / 3 END)
      + (CASE WHEN n % 2 = 1 THEN 0 WHEN j = n - 1 THEN 5 / 12 WHEN j = n - 2 THEN 2 / 3 WHEN j = n - 3 THEN -1 / 12 ELSE 0 END) END"""
    return f"""WITH {traces}, kp AS (SELECT *, {stack} AS stack FROM tr WHERE ({where})),
th AS (SELECT roi, {sd} * stddev_pop(v) AS th FROM (SELECT roi, unnest(y[{low}:{high}]) AS v FROM kp) GROUP BY roi),
nu AS (SELECT *, row_number() OVER (PARTITION BY roi, stack ORDER BY row_ord) - 1 AS ti FROM kp WHERE stack IS NOT NULL),
fr AS (SELECT roi, stack, trial, row_ord, ti, unnest(y) AS v, unnest(range({frames})) AS i FROM nu),
ab AS (SELECT fr.*, ti * {frames} + i AS gp, v > th AS above FROM fr JOIN th USING (roi)),
is_ AS (SELECT *, gp - row_number() OVER (PARTITION BY roi, stack ORDER BY gp) AS island FROM ab WHERE above),
el AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY gp) - 1 AS j FROM is_ WINDOW w AS (PARTITION BY roi, stack, island)),
wt AS (SELECT *, n - (CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) AS odd FROM el),
ev AS (
  SELECT roi, stack, arg_min(trial, gp) AS trial, arg_min(ti, gp) * {frames} AS origin, max(v) AS peak, min(gp) AS g0, min(gp) FILTER (WHERE v = mx) AS gpk, max(gp) AS g1,
         count(*) AS n, sum(v * ({weight})) AS integral
  FROM (SELECT *, max(v) OVER (PARTITION BY roi, stack, island) AS mx FROM wt) GROUP BY roi, stack, island HAVING count(*) >= {least}
)
SELECT roi, trial, round(peak, 6) AS peak, round((g0 - origin + {base}) / {fps}, 6) AS ev_onset, round((gpk - origin + {base}) / {fps}, 6) AS peak_time,
       round((g1 - origin + {base}) / {fps}, 6) AS ev_offset, round(n / {fps}, 6) AS ev_duration, round(integral, 6) AS integral
FROM ev WHERE {having}"""


BRANCH_SQL = "CASE WHEN outcome LIKE '%CATCH%' THEN 'CATCH' ELSE outcome END"
EVENT_COLUMNS = ["roi", "trial", *ALL]


@query(_detect_sql("row_ord", 0.5, 4))
def detect_per_trial(spark, sf):
    return rounded(D.detect(adapters.traces(spark, sf), "per_trial", FPS, **LOOSE).select(*EVENT_COLUMNS))


@query(ORACLES["detect_per_trial"])
def detect_in_place(spark, sf):
    """Detection over traces in buckets of units."""
    return rounded(D.detect(_bucketed(spark, adapters.traces(spark, sf)), "per_trial", FPS, **LOOSE).select(*EVENT_COLUMNS))


@query(_detect_sql(BRANCH_SQL, 0.5, 4))
def detect_per_branch(spark, sf):
    return rounded(D.detect(adapters.traces(spark, sf), "per_branch", FPS, **LOOSE).select(*EVENT_COLUMNS))


@query(_detect_sql(BRANCH_SQL, 0.5, 4))
def detect_per_branch_stream(spark, sf):
    """The same stacks as a stream: three slices of trials in their order, then a row that carries the time past them all."""
    kept = adapters.traces(spark, sf).where(D.is_validated())
    limits, last = D.thresholds(kept, FPS, (2.0, 3.0), LOOSE["sd"]), kept.agg(F.max("row_ord")).first()[0] or 0
    timed = kept.withColumn("ts", F.timestamp_seconds(F.col("row_ord") * 10 + 10))
    slices = [timed.where(F.floor(F.col("row_ord") * 3 / (last + 1)) == i) for i in range(3)]
    # Of no known unit, but of the one session there is: what the join rules out is left out before it moves the watermark.
    known = {"session": F.lit("s"), "roi": F.lit("none"), "outcome": F.lit("FA"), "ts": F.timestamp_seconds(F.lit(last * 10) + 30 * 86_400)}
    end = spark.range(1).select(*[known.get(c, F.lit(None).cast(t)).alias(c) for c, t in timed.dtypes])
    found = replay(spark, [*slices, end], lambda rows: stacked_stream(rows, limits, "ts", "per_branch", FPS, "1 hour", "20 days", LOOSE["min_samples"]))
    return rounded(found.select(*EVENT_COLUMNS))


@query(_detect_sql("'all'", 0.5, 4, having="(g0 - origin) / 10 > 2.0 AND (g0 - origin) / 10 < 5.0"))
def detect_flattened(spark, sf):
    return rounded(D.detect(adapters.traces(spark, sf), "flattened", FPS, window=(2.0, 5.0), validated_only=False, **LOOSE).select(*EVENT_COLUMNS))


@query(_detect_sql("row_ord", 1.0, 2, 11, 20, having="g0 - origin > 0"))
def event_metrics_table(spark, sf):
    return rounded(D.event_table(adapters.traces(spark, sf), FPS, **FEW).select(*EVENT_COLUMNS))


@query(f"""WITH {TRACES_SQL}, fr AS (SELECT roi, trial, unnest(y) AS v, unnest(range(64)) AS i FROM tr),
ab AS (SELECT *, v > 0.05 AS above, v > 0.1 AS over FROM fr),
ed AS (SELECT *, CASE WHEN above IS DISTINCT FROM lag(above) OVER w THEN 1 ELSE 0 END AS edge FROM ab WINDOW w AS (PARTITION BY trial ORDER BY i)),
sg AS (SELECT *, sum(edge) OVER (PARTITION BY trial ORDER BY i) AS seg FROM ed)
SELECT roi, trial, min(i)::INT AS start, count(*) AS width, round(sum(v), 6) AS total FROM sg GROUP BY roi, trial, seg HAVING count(*) FILTER (WHERE over) >= 2""")
def detect_hysteresis(spark, sf):
    found = D.detect_segments(adapters.traces(spark, sf), F.lit(0.1), F.lit(0.05), 2)
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return rounded(found.select("roi", "trial", "start", F.size("values").cast("long").alias("width"), total.alias("total")))


@query(f"""WITH {TRACES_SQL}, fr AS (SELECT trial, unnest(y) AS v, unnest(range(64)) AS j FROM tr)
SELECT trial, round(sum(v * ((CASE WHEN j >= 63 THEN 0 WHEN j = 0 OR j = 62 THEN 1 / 3 WHEN j % 2 = 1 THEN 4 / 3 ELSE 2 / 3 END)
  + (CASE j WHEN 63 THEN 5 / 12 WHEN 62 THEN 2 / 3 WHEN 61 THEN -1 / 12 ELSE 0 END))), 6) AS integral FROM fr GROUP BY trial""")
def simpson_integral(spark, sf):
    return rounded(adapters.traces(spark, sf).select("trial", simpson("y").alias("integral")))


@query(f"SELECT CASE WHEN trial % 4 < 2 THEN 'target' ELSE 'reference' END AS side, * FROM ({_detect_sql('row_ord', 0.5, 4, base=1)})")
def regenerate_sides_reward(spark, sf):
    found = D.detect(adapters.traces(spark, sf), "per_trial", FPS, label_base=1, **LOOSE)
    return rounded(found.select(side_of(False, "reward").alias("side"), *EVENT_COLUMNS))


LONG_SQL = """tr AS (
  SELECT label, label::VARCHAR AS roi, vec_id AS trial, CASE vec_id % 4 WHEN 0 THEN 'cHIT' WHEN 1 THEN 'nHIT' WHEN 2 THEN 'cCATCH' ELSE 'FA' END AS outcome, vec_id AS row_ord,
         list_concat(list_concat(e, list_reverse(e)), list_concat([x * 1.25 FOR x IN e], [-x FOR x IN e])) AS y
  FROM (SELECT *, embedding::DOUBLE[] AS e FROM embeddings)
)"""
_PASSIVE = "CASE trial % 4 WHEN 0 THEN 'cRew' WHEN 1 THEN 'nRew' WHEN 2 THEN 'cStim' ELSE 'none' END"


def _regenerate_sql() -> str:
    within = lambda base, fps: f"(g0 - origin + {base}) / {fps} > 5.0 AND (g0 - origin + {base}) / {fps} < 7.0"
    task = "CASE WHEN trial % 4 < 2 THEN 'target' ELSE 'reference' END AS side, 's' || (roi::INT % 2) || '_' || roi || '.0' AS k0, NULL::VARCHAR AS k1"
    passive = "CASE trial % 4 WHEN 2 THEN 'reference' ELSE 'target' END AS side, 'RGECO_GCaMP_Batch1_m' || (roi::INT % 2) AS k0, roi AS k1"
    outcome = "CASE trial % 4 WHEN 0 THEN 'cHIT' WHEN 1 THEN 'nHIT' WHEN 2 THEN 'cCATCH' ELSE 'FA' END"
    rows = lambda group, head, outcome, history, found: f"SELECT '{group}' AS grp, {head}, {outcome} AS outcome, {history} AS history, * EXCLUDE (roi) FROM ({found})"
    long_ = {"traces": LONG_SQL, "frames": 256}
    parts = [
        rows("task_axons", task, outcome, "NULL::VARCHAR", _detect_sql("row_ord", 0.5, 4, 62, 92, base=1, having=within(1, 30.54), fps=30.54, **long_)),
        rows("NO_DREADDs", task, outcome, "NULL::VARCHAR", _detect_sql(BRANCH_SQL, 0.5, 4, 62, 92, having=within(0, 30.54), fps=30.54, **long_)),
    ]
    for group, own in (("passive_axons", "label % 4 < 2"), ("passive_dendrites", "label % 4 >= 2")):
        found = _detect_sql("'all'", 0.5, 4, 1, 61, where=own, having=within(0, 30.3), fps=30.3, **long_)
        parts.append(rows(group, passive, _PASSIVE, _PASSIVE, found) + " WHERE trial % 4 <> 3")
    return "SELECT * EXCLUDE (grp, trial), grp AS \"group\", trial::VARCHAR AS trial FROM (" + " UNION ALL ".join(parts) + ")"


@query(_regenerate_sql())
def regenerate_events(spark, sf):
    found = regenerate(adapters.recordings(spark, sf), EventTableParams(threshold_sd=0.5, min_samples=4), "reward")
    return rounded(found.drop("row_ord"))


SIDE_OF_TRIAL = "CASE trial % 4 WHEN 0 THEN 'reference' WHEN 1 THEN 'reference' WHEN 2 THEN 'target' END AS side"


@query(f"SELECT {SIDE_OF_TRIAL}, * FROM ({_detect_sql("'all'", 0.5, 4)}) WHERE trial % 4 <> 3")
def regenerate_sides_stimulus(spark, sf):
    history = F.element_at(F.array(*map(F.lit, ("cRew", "nRew", "cStim", "nan"))), (F.col("trial") % 4 + 1).cast("int"))
    rows = adapters.traces(spark, sf).withColumn("outcome", history)
    found = D.detect(rows, "flattened", FPS, validated_only=False, **LOOSE).withColumn("side", side_of(True, "stimulus"))
    return rounded(found.where("side is not null").select("side", *EVENT_COLUMNS))


@query(f"WITH {TRACES_SQL}, fr AS (SELECT roi, unnest(y) AS v, unnest(range(64)) AS i FROM tr) SELECT roi, i::INT AS frame, round(avg(v), 6) AS mean, count(*) AS n FROM fr GROUP BY ALL")
def mean_trace(spark, sf):
    return rounded(display.mean_trace(adapters.traces(spark, sf)).select("roi", "frame", "mean", "n"))


@query("WITH e AS (SELECT DISTINCT roi, trial FROM (" + _detect_sql("row_ord", 0.5, 4) + f")), {TRACES_SQL} SELECT tr.roi, tr.trial, e.trial IS NOT NULL AS is_event, row_number() OVER (PARTITION BY tr.roi ORDER BY CASE WHEN e.trial IS NULL THEN 1 ELSE 0 END, row_ord) - 1 AS place FROM tr LEFT JOIN e ON tr.roi = e.roi AND tr.trial = e.trial")
def waterfall_order(spark, sf):
    rows = adapters.traces(spark, sf)
    found = D.detect(rows, "per_trial", FPS, **LOOSE)
    return display.waterfall_order(rows, found).select("roi", "trial", "is_event", "place")


# A Butterworth filter of third order with its cut-off at a fifth, by the bilinear transform; both ends mirrored oddly for
# 12 frames; forwards, then backwards, each time from the state of a long constant input.
LOWPASS_SQL = f"""WITH RECURSIVE {TRACES_SQL}, k AS (SELECT tan(pi() * 0.2 / 2) AS w), dn AS (SELECT w, 1 + 2 * w + 2 * w ** 2 + w ** 3 AS d FROM k),
co AS (SELECT w ** 3 / d AS b0, 3 * w ** 3 / d AS b1, 3 * w ** 3 / d AS b2, w ** 3 / d AS b3, (-3 - 2 * w + 2 * w ** 2 + 3 * w ** 3) / d AS a1,
  (3 - 2 * w - 2 * w ** 2 + 3 * w ** 3) / d AS a2, (-1 + 2 * w - 2 * w ** 2 + w ** 3) / d AS a3 FROM dn),
zi AS (SELECT *, b3 - a3 AS z2, b3 - a3 + b2 - a2 AS z1, b3 - a3 + b2 - a2 + b1 - a1 AS z0 FROM co),
wide AS (SELECT roi, trial, list_concat(list_concat([2 * y[1] - x FOR x IN list_reverse(y[2:13])], y), [2 * y[64] - x FOR x IN list_reverse(y[52:63])]) AS x FROM tr),
f1(roi, trial, x, t, s0, s1, s2, v) AS (
  SELECT roi, trial, x, 0, z0 * x[1], z1 * x[1], z2 * x[1], NULL::DOUBLE FROM wide, zi
  UNION ALL
  SELECT roi, trial, x, t + 1, s1 + b1 * x[t + 1] - a1 * (b0 * x[t + 1] + s0), s2 + b2 * x[t + 1] - a2 * (b0 * x[t + 1] + s0), b3 * x[t + 1] - a3 * (b0 * x[t + 1] + s0), b0 * x[t + 1] + s0
  FROM f1, zi WHERE t < 88
), back AS (SELECT roi, trial, list(v ORDER BY t DESC) AS x FROM f1 WHERE t > 0 GROUP BY roi, trial),
f2(roi, trial, x, t, s0, s1, s2, v) AS (
  SELECT roi, trial, x, 0, z0 * x[1], z1 * x[1], z2 * x[1], NULL::DOUBLE FROM back, zi
  UNION ALL
  SELECT roi, trial, x, t + 1, s1 + b1 * x[t + 1] - a1 * (b0 * x[t + 1] + s0), s2 + b2 * x[t + 1] - a2 * (b0 * x[t + 1] + s0), b3 * x[t + 1] - a3 * (b0 * x[t + 1] + s0), b0 * x[t + 1] + s0
  FROM f2, zi WHERE t < 88
)
SELECT roi, trial, (76 - t)::INT AS frame, round(v, 6) AS v FROM f2 WHERE t > 12 AND t <= 76"""


@query(LOWPASS_SQL)
def lowpass(spark, sf):
    made = signal.lowpass(adapters.traces(spark, sf))
    return rounded(made.select("roi", "trial", F.posexplode("y").alias("frame", "v")))


@query(ORACLES["lowpass"])
def lowpass_in_blocks(spark, sf):
    """The same, by blocks of 20 frames: the frames of a trace are those before its block, and its own."""
    block = F.explode(F.sequence(F.lit(0), F.floor((F.size("y") - 1) / 20))).alias("block")
    cut = adapters.traces(spark, sf).select("roi", "trial", block, "y").withColumn("y", F.slice("y", (F.col("block") * 20 + 1).cast("int"), 20))
    made = signal.lowpass_blocks(cut, ["roi", "trial"]).select("roi", "trial", "block", F.posexplode("y").alias("i", "v"))
    return rounded(made.select("roi", "trial", (F.col("block") * 20 + F.col("i")).cast("int").alias("frame"), "v"))


# Grouping ------------------------------------------------------------------------------------------------------------

STEMS = ("task_dendrites_TD0", "task_dendrites_TD1", "MODIFIED_task_dendrites_TD3", "control_dendrites_TD1", "control_dendrites_TD2", "task_axons")
POOLED_SQL = f"""WITH fl AS (
  SELECT event_id AS row_ord, [{', '.join(f"'{s}'" for s in STEMS)}][event_id % 6 + 1] AS stem, 's' || (user_id % 3) AS k0, 'r' || (event_id % 41) AS k1 FROM events
), ti AS (SELECT *, replace(stem, 'MODIFIED_', '') AS title FROM fl), la AS (
  SELECT *, title LIKE '%TD1%' AS gone, CASE WHEN title LIKE '%TD0%' OR title LIKE '%TD1%' THEN CASE WHEN title LIKE '%task%' THEN 'task' ELSE 'control' END || '_dendrites (pre-CNO)'
    WHEN title LIKE '%TD2%' OR title LIKE '%TD3%' THEN CASE WHEN title LIKE '%task%' THEN 'task' ELSE 'control' END || '_dendrites (post-CNO)' ELSE title END AS protocol FROM ti
)"""


def _files(spark, sf) -> DataFrame:
    stem = F.element_at(F.array(*map(F.lit, STEMS)), (F.col("event_id") % 6 + 1).cast("int"))
    unit = F.concat(F.lit("r"), (F.col("event_id") % 41).cast("string"))
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("row_ord"), stem.alias("stem"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("k0"), unit.alias("k1"))


@query(POOLED_SQL + " SELECT row_ord, stem, protocol, k0, k1 FROM la WHERE (protocol, k0, k1) IN (SELECT (CASE WHEN gone THEN title ELSE protocol END, k0, k1) FROM la)")
def group_events_legacy(spark, sf):
    return grouping.pooled_events(_files(spark, sf)).select("row_ord", "stem", "protocol", "k0", "k1")


@query(POOLED_SQL + " SELECT row_ord, stem, protocol, k0, k1 FROM la WHERE NOT gone")
def group_events_corrected(spark, sf):
    return grouping.pooled_events(_files(spark, sf), legacy=False).select("row_ord", "stem", "protocol", "k0", "k1")


@query(POOLED_SQL + " SELECT row_ord, stem, k0, k1, false AS found FROM fl WHERE stem <> 'task_axons' UNION ALL SELECT row_ord + 1000000000, 'task_axons', k0, k1, true FROM fl")
def mixed_pool(spark, sf):
    files = _files(spark, sf).withColumn("found", F.lit(False))
    found = files.select((F.col("row_ord") + 1_000_000_000).alias("row_ord"), F.lit("task_axons").alias("group"), "k0", "k1", F.lit(True).alias("found"))
    return grouping.replace_groups(files, found).select("row_ord", "stem", "k0", "k1", "found")


FREQUENCY_STEMS = ("TD0_COHORT_f", "MODIFIED_TD3_COHORT_f", "TD2_CONTROL_f", "MODIFIED_TD3_CONTROL_f", "TD1_CONTROL_f")


def _universe_sql(legacy: bool) -> str:
    control = "split_part(stem, '_', 1)" if legacy else "CASE WHEN stem LIKE '%MODIFIED%' THEN split_part(stem, '_', 2) ELSE split_part(stem, '_', 1) END"
    one = "SELECT id, compartment, st.roi FROM (SELECT DISTINCT id, compartment FROM b1) CROSS JOIN st" if legacy else "SELECT DISTINCT id, compartment, roi FROM b1"
    return f"""WITH fq AS (
  SELECT DISTINCT [{', '.join(f"'{s}'" for s in FREQUENCY_STEMS)}][event_id % 5 + 1] AS stem, 's' || (user_id % 3) AS k0, 'r' || (event_id % 41) AS k1 FROM events
), d AS (
  SELECT *, CASE WHEN stem LIKE '%COHORT%' THEN CASE WHEN stem LIKE '%MODIFIED%' THEN split_part(stem, '_', 2) ELSE split_part(stem, '_', 1) END ELSE {control} END AS td FROM fq
), b1 AS (SELECT DISTINCT 'm' || (user_id % 4) AS id, CASE WHEN user_id % 2 = 0 THEN 'AXONS' ELSE 'DENDRITES' END AS compartment, 'q' || (user_id % 9) AS roi FROM events
), b3 AS (SELECT 'n' || (user_id % 3) AS id, 'FOV' || (user_id % 2) AS fov, 'q' || (user_id % 7) AS roi, min(event_id) AS ord FROM events GROUP BY ALL
), lf AS (SELECT id, fov, min(ord) AS ord FROM b3 GROUP BY ALL ORDER BY ord DESC LIMIT 1), st AS (SELECT b3.roi FROM b3 JOIN lf ON b3.id = lf.id AND b3.fov = lf.fov)
SELECT CASE WHEN stem LIKE '%COHORT%' THEN 'task' ELSE 'control' END || '_dendrites' || CASE WHEN td IN ('TD0', 'TD1') THEN ' (pre-CNO)' ELSE ' (post-CNO)' END AS protocol, k0, k1
FROM d WHERE td IN ('TD0', 'TD2', 'TD3')
UNION ALL SELECT 'passive_axons', 'GCaMP_POm_Batch3_' || id || '_' || fov, roi FROM b3
UNION ALL SELECT CASE WHEN compartment = 'AXONS' THEN 'passive_axons' ELSE 'passive_dendrites' END, 'RGECO_GCaMP_Batch1_' || id, roi FROM ({one})"""


def _universe(spark, sf, legacy: bool) -> DataFrame:
    raw = spark.read.parquet(f"{sf}/events.parquet")
    pick = lambda p, n, c="user_id": F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    stem = F.element_at(F.array(*map(F.lit, FREQUENCY_STEMS)), (F.col("event_id") % 5 + 1).cast("int"))
    frequencies = raw.select(stem.alias("stem"), pick("s", 3).alias("k0"), pick("r", 41, "event_id").alias("k1"))
    protocol, order = F.lit("NAIVE STIM REW").alias("protocol"), F.col("event_id").alias("row_ord")
    tables = {
        "traces_batch1": raw.select(protocol, pick("m", 4).alias("id"), F.when(F.col("user_id") % 2 == 0, "AXONS").otherwise("DENDRITES").alias("compartment"), pick("q", 9).alias("roi"), order),
        "traces_batch3": raw.select(protocol, pick("n", 3).alias("id"), pick("FOV", 2).alias("fov"), pick("q", 7).alias("roi"), order),
    }
    return grouping.unit_universe(frequencies, tables, legacy)


@query(_universe_sql(True))
def roi_universe_legacy(spark, sf):
    return _universe(spark, sf, True)


@query(_universe_sql(False))
def roi_universe_corrected(spark, sf):
    return _universe(spark, sf, False)


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT protocol, k0, CASE WHEN protocol LIKE '%passive%' THEN history WHEN outcome = 'cHIT' THEN 'HIT' ELSE outcome END AS ttype, count(DISTINCT trial) AS n FROM ev GROUP BY ALL),
al AS (SELECT * FROM c UNION ALL SELECT protocol, k0, 'ALL', sum(n) FROM c GROUP BY ALL),
s AS (SELECT protocol, k0, CASE WHEN protocol LIKE '%passive%' THEN sum(n) FILTER (WHERE ttype LIKE '%Rew%') WHEN protocol LIKE '%CNO%' THEN sum(n) FILTER (WHERE ttype LIKE '%HIT%') ELSE sum(n) FILTER (WHERE ttype = 'HIT') END AS t,
  CASE WHEN protocol LIKE '%passive%' THEN sum(n) FILTER (WHERE ttype NOT LIKE '%Rew%') WHEN protocol LIKE '%CNO%' THEN sum(n) FILTER (WHERE ttype NOT LIKE '%HIT%') ELSE sum(n) FILTER (WHERE ttype = 'ALL') - sum(n) FILTER (WHERE ttype = 'HIT') END AS r FROM al GROUP BY protocol, k0)
SELECT DISTINCT protocol, k0, k1, t::BIGINT AS n_target, r::BIGINT AS n_reference FROM ev JOIN s USING (protocol, k0)""")
def modulation_denominators(spark, sf):
    rows = _events(spark, sf)
    label = F.when(F.col("protocol").contains("passive"), F.col("history")).when(F.col("outcome") == "cHIT", "HIT").otherwise(F.col("outcome"))
    counts = adapters.trial_counts(rows.withColumn("label", label), "label")
    counts = counts.unionByName(counts.groupBy("protocol", "session").agg(F.lit("ALL").alias("ttype"), F.sum("n").alias("n")))
    counts = counts.withColumn("td", F.when(F.col("protocol").contains("CNO"), "TD0"))
    return grouping.modulation_denominators(rows.select("protocol", "k0", "k1"), counts, "reward")


# Latency, validation, display ----------------------------------------------------------------------------------------

LATENCY_SQL = MEDIAN_SQL + """, lk AS (
  SELECT 'r' || user_id AS session, day(ts)::BIGINT AS trial, avg(value) / 1000 AS lick_latency FROM events WHERE event_type = 'click' GROUP BY ALL
), pt AS (
  SELECT k1 AS session, trial, avg(ev_onset - 5.0) AS ev_onset FROM ev WHERE side = 'target' AND ev_onset > 5.0 AND ev_onset < 6.5
    AND k1 IN (SELECT k1 FROM md) GROUP BY ALL
), pl AS (SELECT pt.session, pt.trial, pt.ev_onset, lk.lick_latency FROM pt LEFT JOIN lk ON pt.session = lk.session AND pt.trial = lk.trial),
zs AS (
  SELECT session, trial, (lick_latency - avg(lick_latency) OVER ()) / stddev_pop(lick_latency) OVER () AS lick_latency,
         (ev_onset - avg(ev_onset) OVER ()) / stddev_pop(ev_onset) OVER () AS ev_onset FROM pl WHERE lick_latency IS NOT NULL
), zc AS (SELECT * FROM zs WHERE abs(lick_latency) < 2.5 AND abs(ev_onset) < 2.5)"""


def _latencies(spark, sf) -> DataFrame:
    rows = _events(spark, sf).where("side = 'target'").withColumn("k0", F.col("k1"))
    units = modulation.modulated_units(_indices(spark, sf), "median").select(F.col("k1").alias("k0"), "k1")
    return latency.per_trial_latencies(rows, units, adapters.lick_latency(spark, sf), (5.0, 6.5))


@query(LATENCY_SQL + " SELECT session, trial, round(ev_onset, 6) AS ev_onset, round(lick_latency, 6) AS lick_latency FROM pl")
def per_trial_latency(spark, sf):
    return rounded(_latencies(spark, sf))


@query(LATENCY_SQL + " SELECT session, trial, round(ev_onset, 6) AS ev_onset, round(lick_latency, 6) AS lick_latency FROM zc")
def latency_zscore_clip(spark, sf):
    return rounded(latency.zscored(_latencies(spark, sf), 2.5).select("session", "trial", "ev_onset", "lick_latency"))


@query(LATENCY_SQL + """, ln AS (SELECT corr(ev_onset, lick_latency) AS r, regr_slope(ev_onset, lick_latency) AS slope, regr_intercept(ev_onset, lick_latency) AS intercept, count(*) AS n_points FROM zc),
tt AS (SELECT *, n_points - 2 AS nu, atan(abs(r * sqrt((n_points - 2) / ((1 - r) * (1 + r)))) / sqrt(n_points - 2)) AS th FROM ln)
SELECT round(r, 6) AS r, """ + TAIL_SQL.replace("p_value", "p") + """, round(slope, 6) AS slope, round(intercept, 6) AS intercept, n_points,
  (SELECT count(lick_latency) FROM pl) AS n_trials, (SELECT count(*) - count(lick_latency) FROM pl) AS n_no_lick, (SELECT count(DISTINCT session) FROM pl WHERE lick_latency IS NOT NULL) AS n_sessions FROM tt""")
def latency_regression(spark, sf):
    return rounded(latency.latency_correlation(_latencies(spark, sf), 2.5)[1])


@query(f"""WITH {EVENTS_SQL}, ref AS (SELECT protocol AS grp, side, k0 || '|' || k1 || '|' || trial AS key, * FROM ev),
fo AS (SELECT grp, side, key, row_ord, ev_onset + CASE WHEN row_ord % 7 = 0 THEN 20 WHEN row_ord % 6 = 5 THEN 0.5 ELSE 0 END AS ev_onset, ev_offset + CASE WHEN row_ord % 5 = 0 THEN 0.25 ELSE 0 END AS ev_offset, peak + row_ord % 3 AS peak, peak_time, ev_duration, integral FROM ref),
j AS (SELECT r.grp, r.side, r.row_ord, f.row_ord AS f, abs(f.ev_offset - r.ev_offset) <= 1e-9 AS ex, abs(f.peak - r.peak) AS dp, abs(f.peak_time - r.peak_time) AS dt, abs(f.ev_duration - r.ev_duration) AS dd, abs(f.integral - r.integral) AS di
  FROM ref r LEFT JOIN fo f ON r.grp = f.grp AND r.side = f.side AND r.key = f.key AND abs(f.ev_onset - r.ev_onset) <= 1e-9),
b AS (SELECT grp, side, row_ord, bool_or(coalesce(ex, false)) AS exact, count(f) AS n, coalesce(min(f) FILTER (WHERE ex), max(f)) AS f FROM j GROUP BY ALL),
m AS (SELECT b.*, j.dp, j.dt, j.dd, j.di FROM b LEFT JOIN j ON b.grp = j.grp AND b.side = j.side AND b.row_ord = j.row_ord AND b.f = j.f)
SELECT m.grp AS "group", m.side, count(*) AS n_reference, any_value(c.n) AS n_regenerated, count(*) FILTER (WHERE exact) AS n_exact, count(*) FILTER (WHERE NOT exact AND m.n > 0) AS n_onset_only, count(*) FILTER (WHERE m.n = 0) AS n_missing,
  any_value(c.n) - count(DISTINCT f) AS n_extra, round(coalesce(max(dp) FILTER (WHERE exact), 0), 6) AS max_peak_diff, round(coalesce(max(dt) FILTER (WHERE exact), 0), 6) AS max_peak_time_diff,
  round(coalesce(max(dd) FILTER (WHERE exact), 0), 6) AS max_ev_duration_diff, round(coalesce(max(di) FILTER (WHERE exact), 0), 6) AS max_integral_diff, round(count(*) FILTER (WHERE exact) / count(*), 6) AS exact_fraction
FROM m JOIN (SELECT grp, side, count(*) AS n FROM fo GROUP BY ALL) c ON m.grp = c.grp AND m.side = c.side GROUP BY m.grp, m.side""")
def match_report(spark, sf):
    reference = _events(spark, sf).withColumnRenamed("protocol", "group")
    o = F.col("row_ord")
    moved = {"ev_onset": F.col("ev_onset") + F.when(o % 7 == 0, 20.0).when(o % 6 == 5, 0.5).otherwise(0.0), "ev_offset": F.col("ev_offset") + F.when(o % 5 == 0, 0.25).otherwise(0.0), "peak": F.col("peak") + o % 3}
    return rounded(validation.match_report(reference.withColumns(moved), reference))


HISTOGRAM_SQL = f"""WITH {EVENTS_SQL}, tt AS (
  SELECT protocol, count(DISTINCT k0 || '/' || trial) FILTER (WHERE side = 'target') AS n_target, count(DISTINCT k0 || '/' || trial) FILTER (WHERE side = 'reference') AS n_reference,
         count(DISTINCT k0 || '/' || k1) FILTER (WHERE side = 'target') AS n_units FROM ev GROUP BY protocol
), bi AS (
  SELECT protocol, side, least((SELECT max(i) FROM range(15) t(i) WHERE 5.0::DOUBLE + i * 0.1::DOUBLE <= ev_onset), 14)::INT AS bin, count(*) AS n_events
  FROM ev WHERE ev_onset >= 5.0 AND ev_onset <= 6.5 GROUP BY ALL
)"""


def _histogram(spark, sf, divide: bool) -> DataFrame:
    rows = _events(spark, sf)
    of = lambda side, c: F.count_distinct(F.when(F.col("side") == side, F.concat_ws("/", "k0", c)))
    totals = rows.groupBy("protocol").agg(of("target", "trial").alias("n_target"), of("reference", "trial").alias("n_reference"))
    units = rows.groupBy("protocol").agg(of("target", "k1").alias("n_units"))
    return rounded(display.onset_histogram(rows, totals, unit_counts=units if divide else None), 9)


@query(HISTOGRAM_SQL + " SELECT protocol, side, bin, n_events, round(n_events / CASE side WHEN 'target' THEN n_target ELSE n_reference END, 9) AS weight FROM bi JOIN tt USING (protocol)")
def onset_histogram(spark, sf):
    return _histogram(spark, sf, False)


@query(HISTOGRAM_SQL + " SELECT protocol, side, bin, n_events, round(n_events / CASE side WHEN 'target' THEN n_target ELSE n_reference END / n_units, 9) AS weight FROM bi JOIN tt USING (protocol)")
def onset_histogram_roi_div(spark, sf):
    return _histogram(spark, sf, True)


@query("SELECT event_id, user_id || '_r' || event_id % 9 || '_' || event_id % 13 || '::' || event_id % 5 AS key FROM events")
def canonical_roi_key(spark, sf):
    s = lambda c: F.col(c).cast("string")
    raw = F.concat_ws("_", F.concat(s("user_id"), F.lit(".0")), F.concat(F.lit("r"), (F.col("event_id") % 9).cast("string")), F.concat((F.col("event_id") % 13).cast("string"), F.lit(".0")))
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return rows.select("event_id", canonical_key(raw, F.concat((F.col("event_id") % 5).cast("string"), F.lit(".0"))).alias("key"))


@query(f"WITH {METRICS_SQL} SELECT protocol, outcome, count(rate) AS n, round(avg(rate), 6) AS mean, round(CASE WHEN count(rate) > 1 THEN stddev_samp(rate) / sqrt(count(rate)) ELSE 0 END, 6) AS sem, string_agg(format('{{:.6f}}', rate), ',' ORDER BY rate) AS points FROM m WHERE protocol = 'task_axons' AND outcome IN ('cHIT', 'nHIT') GROUP BY ALL")
def comparison_bars(spark, sf):
    values = metrics.comparison_values(_metrics(spark, sf), "rate")
    bars = display.strip_values(values, [("task_axons", "cHIT"), ("task_axons", "nHIT")])
    points = F.array_join(F.transform("values", lambda v: F.format_string("%.6f", v)), ",")
    return rounded(bars.withColumn("points", points).drop("values"))


# Files: the tables written in the layouts of recordings, and read back -------------------------------------------------

FILES_SQL = EVENTS_SQL + """, fi AS (
  SELECT *, 'part' || (row_ord % 8) || '_MODIFIED_' || CASE WHEN protocol LIKE '%dendrites%' THEN 'task_dendrites_TD0' ELSE protocol END AS stem, protocol IN ('task_axons', 'NO_DREADDs') AS task FROM ev
)"""


@query(f"""WITH {FILES_SQL} SELECT side, stem, CASE WHEN task THEN k0 || '_' || k1 || '.0' ELSE k0 END AS k0, CASE WHEN NOT task THEN k1 END AS k1, trial::VARCHAR AS trial,
  CASE WHEN protocol NOT LIKE '%passive%' THEN outcome END AS outcome, CASE WHEN protocol LIKE '%passive%' THEN history END AS history, {_r(*ALL)} FROM fi""")
def event_files(spark, sf):
    """Event files in three layouts, of both sides, as one table."""
    folder = adapters.shared_path(spark, "events")
    adapters.event_files(spark, sf, folder)
    sides = [read_event_folder(spark, folder, suffix).withColumn("side", F.lit(side)) for side, suffix in zip(("target", "reference"), SUFFIXES["reward"], strict=True)]
    return rounded(sides[0].unionByName(sides[1]).drop("row_ord"))


@query(f"""WITH {EVENTS_SQL} SELECT regexp_replace(protocol, '[^A-Za-z_]+', '_', 'g') || '_fullreward_event_frequencies' AS stem, k0, k1,
  {', '.join(f"count(*) FILTER (WHERE outcome = '{o}') / 8 AS \"{o}\"" for o in ("cHIT", "nHIT", "FA"))} FROM ev GROUP BY protocol, k0, k1""")
def frequency_files(spark, sf):
    folder = adapters.shared_path(spark, "frequencies")
    adapters.frequency_files(spark, sf, folder)
    return read_frequencies(spark, folder, FREQUENCY_GLOBS["reward"])


NESTED_SQL = """em AS (
  SELECT vec_id AS vid, vec_id // 64 AS position, 'r' || label AS roi, CASE vec_id % 4 WHEN 0 THEN 'cHIT' WHEN 1 THEN 'nHIT' WHEN 2 THEN 'cCATCH' ELSE 'FA' END AS kind,
         CASE WHEN vec_id % 3 = 0 THEN 'AXONS' ELSE 'DENDRITES' END AS name, embedding::DOUBLE[] AS y FROM embeddings
), fi AS (SELECT *, min(vid) OVER (PARTITION BY position, roi) AS r0, row_number() OVER (PARTITION BY position, roi ORDER BY vid) - 1 AS t FROM em
), fl AS (SELECT *, dense_rank() OVER (PARTITION BY position ORDER BY r0) - 1 AS r FROM fi
), si AS (SELECT *, min(vid) OVER (PARTITION BY position, name, roi) AS g0, row_number() OVER (PARTITION BY position, name, roi ORDER BY vid) - 1 AS gt FROM em
), se AS (SELECT *, dense_rank() OVER (PARTITION BY position, name ORDER BY g0) - 1 AS gr, CASE name WHEN 'AXONS' THEN 0 ELSE least(1, (SELECT count(*) FROM em e WHERE e.position = si.position AND e.name = 'AXONS')) END AS g FROM si)"""


def _nested(spark, sf, name: str, schema: str) -> DataFrame:
    folder = adapters.shared_path(spark, "nested")
    adapters.nested_sources(spark, sf, folder)
    return nested.read_nested(spark, folder, name, schema)


def _total() -> Column:
    return F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 6).alias("total")


@query(f"""WITH {NESTED_SQL} SELECT 's' || position AS id, roi, vid::VARCHAR AS trial, kind AS unvalidated_type, CASE WHEN vid % 2 = 1 THEN vid / 10 END AS response_latency, position AS source_order,
  ((position * 4096 + 0) * 4096 + r) * 1048576 + t AS row_ord, round(list_sum(y), 6) AS total FROM fl""")
def nested_traces(spark, sf):
    """Traces of nested sessions by branch, in the order of the file."""
    traces, _ = nested.flatten_branches(_nested(spark, sf, "task_axons", nested.FLAT), "task_axons")
    return traces.select("id", "roi", "trial", "unvalidated_type", "response_latency", "source_order", "row_ord", _total())


@query(f"""WITH {NESTED_SQL}, br AS (SELECT position, roi, vid, 'ALL' AS ttype FROM em UNION ALL SELECT position, roi, vid, CASE WHEN kind LIKE '%HIT%' THEN 'HIT' ELSE 'other' END FROM em),
un AS (SELECT position, ttype, roi, min(vid) AS first, count(*) AS n FROM br GROUP BY ALL)
SELECT 's' || position AS id, ttype, arg_min(n, first)::INT AS n_trials FROM un GROUP BY position, ttype""")
def nested_trial_counts(spark, sf):
    return nested.flatten_branches(_nested(spark, sf, "task_axons", nested.FLAT), "task_axons")[1].select("id", "ttype", "n_trials")


@query(f"""WITH {NESTED_SQL} SELECT 'm' || position AS id, name AS compartment, roi, vid::INT AS trial, position * 16777216 + g AS source_order, ((position * 65536 + g) * 4096 + gr) * 1048576 + gt AS row_ord,
  round(list_sum(y), 6) AS total FROM se""")
def nested_series(spark, sf):
    """Traces of nested sessions by protocol and group."""
    traces, _ = nested.flatten_series(_nested(spark, sf, "batch1", nested.SERIES), "batch1")
    return traces.select("id", "compartment", "roi", "trial", "source_order", "row_ord", _total())


@query(f"""WITH {NESTED_SQL} SELECT 'RGECO_GCaMP_Batch1_m' || position AS session, vid AS trial, CASE WHEN vid % 2 = 1 THEN vid / 10 END AS lick_latency FROM em WHERE name = 'DENDRITES'""")
def reward_lick_latency(spark, sf):
    """Lick latencies of a group from the behaviour of nested sessions; what is no number is null."""
    _, behavior = nested.flatten_series(_nested(spark, sf, "batch1", nested.SERIES), "batch1")
    return latency.reward_lick_latency({"behavior_batch1": behavior}, "passive_dendrites")


@query(f"""WITH {TRACES_SQL}, w AS (SELECT roi, trial, outcome, round(list_sum(y), 6) AS total, row_ord FROM tr), n AS (SELECT count(*) AS n FROM tr)
SELECT w.*, n AS rows_noted FROM w, n""")
def converted_tables(spark, sf):
    """Wide traces, a column a frame, written as a converted table with its manifest, and read back as arrays."""
    folder, rows = adapters.shared_path(spark, "converted"), adapters.traces(spark, sf)
    frames = [F.get("y", F.lit(i)).alias(f"f{i:03d}") for i in range(64)]
    write_tables({"traces_task_axons": rows.select("roi", "trial", "outcome", "row_ord", *frames)}, folder)
    noted = read_manifest(spark, folder)["row_counts"]["traces_task_axons"]
    return read_table(spark, folder, "traces_task_axons").select("roi", "trial", "outcome", _total(), "row_ord", F.lit(noted).cast("long").alias("rows_noted"))
