"""DuckDB SQL for each registered query: the brute-force statement of its meaning
(plain window functions, self-joins, row_number), used only to check results."""

from __future__ import annotations

from ..operators.combos import feature_combinations
from ..operators.groups import objectives_for
from ..operators.prep import drop_features
from ..schema import ID_COLUMNS, gap_name, range_count_name, unique_count_name
from ..sources.clicks import (SUPPLEMENT_START, TEST_END, TEST_ID_OFFSET, TEST_START, TRAIN_END, UNION_ID_OFFSET)
from .features import feature_manifest
from . import queries as q

ALL = feature_combinations(ID_COLUMNS)
WITH_IP = feature_combinations(ID_COLUMNS, include=["ip"])
S = "click_time_int_seconds"

BASE = f"""
WITH c0 AS (
  SELECT event_id AS row_id, event_id AS click_id, CAST(user_id AS BIGINT) AS ip,
         CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                              WHEN 'signup' THEN 3 ELSE 4 END AS INTEGER) AS app,
         CAST(CAST(round(value * 100) AS BIGINT) % 3 AS INTEGER) AS device,
         CAST(CAST(round(value * 100) AS BIGINT) % 7 AS INTEGER) AS os,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS INTEGER) AS channel,
         date_trunc('second', ts) AS click_time
  FROM events),
clicks AS (
  SELECT *, CAST(epoch(click_time) AS INTEGER) AS {S},
         CASE WHEN app = 2 AND channel < 2 AND os < 3 THEN 1 ELSE 0 END AS is_attributed
  FROM c0),
train AS (
  SELECT row_id, ip, app, device, os, channel, click_time, {S}, is_attributed,
         CASE WHEN is_attributed = 1 THEN click_time + INTERVAL 60 SECOND END AS attributed_time
  FROM clicks WHERE click_time < TIMESTAMP '{TRAIN_END}'),
supp AS (
  SELECT click_id, ip, app, device, os, channel, click_time, {S}
  FROM clicks WHERE click_time >= TIMESTAMP '{SUPPLEMENT_START}'),
part AS (SELECT * FROM supp WHERE click_time >= (SELECT max(click_time) FROM train)),
u AS (
  SELECT row_id, 'train' AS split, CAST(NULL AS BIGINT) AS click_id, ip, app, device, os, channel,
         click_time, {S}, is_attributed FROM train
  UNION ALL
  SELECT click_id + {UNION_ID_OFFSET} AS row_id, 'test' AS split, click_id, ip, app, device, os, channel,
         click_time, {S}, CAST(NULL AS INTEGER) AS is_attributed FROM part),
test AS (
  SELECT click_id + {TEST_ID_OFFSET} AS click_id, ip, app, device, os, channel, click_time FROM supp
  WHERE click_time >= TIMESTAMP '{TEST_START}' AND click_time < TIMESTAMP '{TEST_END}')
"""


def _p(combo) -> str:
    return ", ".join(combo)


def _r5(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 5)"


def gap_sql(combo, direction: str, wrap: bool = True) -> str:
    w = f"OVER (PARTITION BY {_p(combo)} ORDER BY {S}, row_id)"
    delta = f"(lead({S}) {w} - {S})" if direction == "forward" else f"({S} - lag({S}) {w})"
    if wrap:
        delta = f"({delta} % 86400)"
    return f"{_r5(f'CAST({delta} AS REAL)')} AS \"{gap_name(combo, direction)}\""


def unique_sql(combo) -> list[str]:
    return [f"CAST(count(DISTINCT {x}) OVER (PARTITION BY {_p(combo)}) AS BIGINT) AS \"{unique_count_name(x, combo)}\""
            for x in objectives_for(combo, ID_COLUMNS)]


def range_sql(combo, back: int, fwd: int) -> str:
    frame = f"RANGE BETWEEN {-back} PRECEDING AND {fwd} FOLLOWING"
    return (f"CAST(count(*) OVER (PARTITION BY {_p(combo)} ORDER BY {S} {frame}) AS BIGINT) "
            f"AS \"{range_count_name(combo, back, fwd)}\"")


def count_sql(combo) -> str:
    return f"CAST(count(*) OVER (PARTITION BY {_p(combo)}) AS BIGINT) AS count_groupby_{'_'.join(combo)}"


HOD = (f"CAST(CAST(hour(click_time) AS DOUBLE) + CAST(minute(click_time) AS DOUBLE) / 60.0"
       f" + CAST(second(click_time) AS DOUBLE) / 3600.0 AS REAL)")
ANGLE = f"((CAST({HOD} AS DOUBLE) - 12.0) / 24.0) * 6.283185307179586"
DATE_PARTS = {
    "year": "CAST(year(click_time) AS INTEGER)",
    "month": "CAST(month(click_time) AS INTEGER)",
    "weekday": "CAST(isodow(click_time) - 1 AS INTEGER)",
    "day": "CAST(day(click_time) AS INTEGER)",
    "hour": "CAST(hour(click_time) AS INTEGER)",
    "minute": "CAST(minute(click_time) AS INTEGER)",
    "second": "CAST(second(click_time) AS INTEGER)",
    "hour_of_day": _r5(HOD),
    "hour_of_day_sin": _r5(f"CAST(sin({ANGLE}) AS REAL)"),
    "hour_of_day_cos": _r5(f"CAST(cos({ANGLE}) AS REAL)"),
}


def _keyed(cols: list[str]) -> str:
    return BASE + f"SELECT row_id, split, {', '.join(cols)} FROM u"


def feature_cte() -> str:
    """``feat``: row_id plus the 180 published features over the union."""
    m = feature_manifest()
    cols = [f"{c} AS raw_{c}" for c in ("channel", "ip", "app", "device", "os")]
    cols += [f"{DATE_PARTS[p]} AS {p}" for p in m["date_time"]]
    cols += [gap_sql(c, d) for c in ALL for d in ("forward", "backward")]
    cols += [s for c in ALL for s in unique_sql(c)]
    cols += [range_sql(c, 0, 3600) for c in WITH_IP]
    cols += [range_sql(c, 0, 21600) for c in WITH_IP]
    return f", feat AS (SELECT row_id, {', '.join(cols)} FROM u)"


def folds_cte(n_folds: int = q.N_FOLDS) -> str:
    return f"""
, trainu AS (SELECT row_id, is_attributed FROM u WHERE split = 'train'),
fids AS (SELECT CAST(range AS INTEGER) AS fold FROM range({n_folds})),
negr AS (
  SELECT f.fold, t.row_id, t.is_attributed,
         row_number() OVER (PARTITION BY f.fold
                            ORDER BY md5(concat(CAST(f.fold AS VARCHAR), '_', CAST(t.row_id AS VARCHAR))), t.row_id) AS rn
  FROM trainu t CROSS JOIN fids f WHERE t.is_attributed = 0),
fs AS (
  SELECT fold, row_id, is_attributed FROM negr
  WHERE rn <= (SELECT count(*) FROM trainu WHERE is_attributed = 1)
  UNION ALL
  SELECT f.fold, t.row_id, t.is_attributed FROM trainu t CROSS JOIN fids f WHERE t.is_attributed = 1)
"""


HOLDOUT = f"""
, sz AS (SELECT fold, CAST(ceil(CAST(count(*) AS DOUBLE) * CAST({q.VALID_FRACTION} AS DOUBLE)) AS BIGINT) AS n
         FROM fs GROUP BY fold),
r AS (SELECT fs.*, row_number() OVER (PARTITION BY fold
        ORDER BY md5(concat('{q.SPLIT_SEED}', '_', CAST(row_id AS VARCHAR))), row_id) AS rn FROM fs)
"""


IDMAP = """
, firstm AS (SELECT ip, app, device, os, channel, click_time, min(click_id) AS old_click_id
             FROM part GROUP BY ip, app, device, os, channel, click_time),
idmap AS (SELECT t.click_id AS new_click_id, f.old_click_id
          FROM test t LEFT JOIN firstm f USING (ip, app, device, os, channel, click_time))
"""


def _names() -> list[str]:
    m = feature_manifest()
    return [n for fam in m.values() for n in fam]


def build() -> dict[str, str]:
    m = feature_manifest()
    names = _names()
    out: dict[str, str] = {}
    out["csv_roundtrip"] = BASE + f"""
SELECT 'train' AS split, CAST(NULL AS BIGINT) AS click_id, ip, app, device, os, channel,
       CAST(epoch(click_time) AS BIGINT) AS click_seconds, CAST(epoch(attributed_time) AS BIGINT) AS attributed_seconds,
       is_attributed FROM train
UNION ALL
SELECT 'test', click_id, ip, app, device, os, channel, CAST(epoch(click_time) AS BIGINT), CAST(NULL AS BIGINT),
       CAST(NULL AS INTEGER) FROM supp"""
    out["raw_features"] = BASE + ("SELECT row_id, split, channel AS raw_channel, ip AS raw_ip, app AS raw_app, "
                                  "device AS raw_device, os AS raw_os FROM u")
    out["epoch_seconds"] = BASE + f"SELECT row_id, split, {S} FROM u"
    out["date_time_features"] = BASE + "SELECT row_id, split, " + ", ".join(
        f"{v} AS {k}" for k, v in DATE_PARTS.items()) + " FROM u"
    out["cutoff_union"] = BASE + f"SELECT row_id, split, click_id, ip, app, device, os, channel, {S}, is_attributed FROM u"
    out["time_bounds"] = BASE + f"""
SELECT 'train' AS split, min({S}) AS first_second, max({S}) AS last_second, count(*) AS n_rows FROM train
UNION ALL
SELECT 'test', min({S}), max({S}), count(*) FROM u WHERE split = 'test'"""
    out["click_gaps_forward"] = _keyed([gap_sql(c, "forward") for c in ALL])
    out["click_gaps_backward"] = _keyed([gap_sql(c, "backward") for c in ALL])
    out["click_gaps_both"] = _keyed([gap_sql(c, d, wrap=False) for c in WITH_IP for d in ("forward", "backward")])
    out["click_gaps_all"] = _keyed([gap_sql(c, d) for c in ALL for d in ("forward", "backward")])
    out["group_click_count"] = _keyed([count_sql(c) for c in ALL])
    sets = ", ".join(f"({_p(c)})" for c in ALL)
    combo = ", ".join(f"CASE WHEN grouping({k}) = 0 THEN '{k}' END" for k in ID_COLUMNS)
    out["cube_counts"] = BASE + f"""
SELECT ip, app, device, os, channel, CAST(count(*) AS BIGINT) AS n_clicks, concat_ws('_', {combo}) AS combo
FROM u GROUP BY GROUPING SETS ({sets})"""
    out["unique_counts_ip"] = _keyed(unique_sql(("ip",)))
    out["unique_counts_all"] = _keyed([s for c in ALL for s in unique_sql(c)])
    out["count_in_range_1h"] = _keyed([range_sql(c, 0, 3600) for c in WITH_IP])
    out["count_in_range_6h"] = _keyed([range_sql(c, 0, 21600) for c in WITH_IP])
    out["count_in_range_back"] = _keyed([range_sql(c, -3600, 0) for c in WITH_IP])
    b, f = q.PROBE_RANGE
    keys = " AND ".join(f"u.{k} = p.{k}" for k in q.PROBE_KEYS)
    out["count_in_range_probes"] = BASE + f"""
, p AS (SELECT click_id, {_p(q.PROBE_KEYS)}, CAST(epoch(click_time) AS INTEGER) AS s FROM test)
SELECT p.click_id, CAST(count(u.row_id) AS BIGINT) AS n_events
FROM p LEFT JOIN u ON {keys} AND u.{S} BETWEEN p.s - {-b} AND p.s + {f}
GROUP BY p.click_id"""
    out["sample_fraction"] = BASE + f"""
, r AS (SELECT row_id, split, {S}, row_number() OVER (
          ORDER BY md5(concat(CAST({q.SAMPLE_SEED} AS VARCHAR), '_', CAST(row_id AS VARCHAR))), row_id) AS rn FROM u)
SELECT row_id, split, {S} FROM r
WHERE rn <= (SELECT CAST(round_even(CAST({q.SAMPLE_FRACTION} AS DOUBLE) * count(*), 0) AS BIGINT) FROM u)"""
    out["time_order"] = BASE + f"SELECT row_id, split, {S}, row_number() OVER (ORDER BY {S}, row_id) - 1 AS place FROM u"
    out["fold_order"] = BASE + folds_cte() + (
        "SELECT fold, row_id, is_attributed, row_number() OVER (PARTITION BY fold ORDER BY row_id) - 1 AS place FROM fs")
    out["class_counts"] = BASE + "SELECT is_attributed, count(*) AS n_rows FROM train GROUP BY is_attributed"
    out["balanced_folds"] = BASE + folds_cte() + "SELECT fold, row_id, is_attributed FROM fs"
    out["train_valid_split"] = BASE + folds_cte() + HOLDOUT + (
        "SELECT r.fold, r.row_id, r.is_attributed, r.rn <= sz.n AS is_valid FROM r JOIN sz USING (fold)")
    out["node_scores"] = BASE + folds_cte() + HOLDOUT + (
        "SELECT r.fold, r.row_id, r.is_attributed, TRUE AS same_score, TRUE AS is_probability FROM r JOIN sz USING (fold) WHERE r.rn <= sz.n")
    out["fold_dataset"] = BASE + folds_cte() + HOLDOUT + f"""
SELECT r.fold, r.rn <= sz.n AS is_valid, r.is_attributed, count(*) AS n_rows,
       CAST({len(drop_features(names))} AS INTEGER) AS least_features, CAST({len(drop_features(names))} AS INTEGER) AS most_features
FROM r JOIN sz USING (fold) GROUP BY ALL"""
    out["fold_training_set"] = BASE + feature_cte() + folds_cte() + (
        "SELECT fs.fold, fs.row_id, " + ", ".join(f'feat."{n}"' for n in names)
        + ", fs.is_attributed FROM fs JOIN feat USING (row_id)")
    out["alignment_check"] = BASE + folds_cte() + """
, lab AS (SELECT fs.row_id FROM fs JOIN u USING (row_id))
SELECT (SELECT count(*) FROM fs WHERE row_id NOT IN (SELECT row_id FROM lab)) AS only_left,
       (SELECT count(*) FROM lab WHERE row_id NOT IN (SELECT row_id FROM fs)) AS only_right"""
    out["test_id_map"] = BASE + IDMAP + "SELECT new_click_id, old_click_id FROM idmap"
    out["test_feature_set"] = BASE + feature_cte() + IDMAP + (
        "SELECT idmap.new_click_id AS click_id, " + ", ".join(f'feat."{n}"' for n in names)
        + f" FROM idmap LEFT JOIN feat ON feat.row_id = idmap.old_click_id + {UNION_ID_OFFSET}")
    scores = " UNION ALL ".join(
        f"SELECT 'raw_{c}' AS feature, CAST({c} AS DOUBLE) AS score, is_attributed FROM train" for c in q.AUC_SCORES)
    out["auc_of_score"] = BASE + f"""
, s AS ({scores}),
r AS (SELECT feature, score, is_attributed,
             rank() OVER (PARTITION BY feature ORDER BY score) AS rk,
             count(*) OVER (PARTITION BY feature, score) AS ties FROM s),
t AS (SELECT feature,
             sum(CASE WHEN is_attributed = 1 THEN CAST(rk AS DOUBLE) + (CAST(ties AS DOUBLE) - 1) / 2 END) AS rsum,
             CAST(sum(is_attributed) AS BIGINT) AS n_pos, CAST(sum(1 - is_attributed) AS BIGINT) AS n_neg
      FROM r GROUP BY feature)
SELECT feature,
       round((rsum - CAST(n_pos AS DOUBLE) * (n_pos + 1) / 2) / (CAST(n_pos AS DOUBLE) * n_neg), 9) AS auc,
       n_pos, n_neg FROM t"""
    out["ensemble_mean"] = BASE + IDMAP + f"""
, fids AS (SELECT CAST(range AS INTEGER) AS fold FROM range({q.N_FOLDS})),
t AS (SELECT idmap.new_click_id AS click_id, u.app, u.os FROM idmap
      LEFT JOIN u ON u.row_id = idmap.old_click_id + {UNION_ID_OFFSET})
SELECT click_id,
       round(avg(1.0 / (1.0 + exp(-(CAST(app AS DOUBLE) - CAST(fold AS DOUBLE) * 0.25 + CAST(os AS DOUBLE) * 0.1)))),
             9) AS is_attributed
FROM t CROSS JOIN fids GROUP BY click_id"""
    return out


ORACLE_SQL = build()
