"""SQL over the given tables that gives the result of each registered query.

Averages are written as exact sums over counts, so that they do not depend on the order of
addition.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions.labels import CONFLICT_CLASSES, QUAD_LABELS
from .queries import AS_OF, COPIES, END, FIRST_COMMIT, SAMPLE, SAMPLE_SHIFT, SEED, START

FIRST_COMMIT_S = int(FIRST_COMMIT.timestamp())

EVENT_LOG = """
SELECT event_id AS globaleventid,
       CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS event_date,
       'A' || CAST(10 + user_id % 90 AS VARCHAR)
         || CASE WHEN user_id % 11 = 0 THEN 'GOV' ELSE '' END AS source_actor,
       'A' || CAST(10 + event_id % 90 AS VARCHAR) AS target_actor,
       CASE event_type WHEN 'view' THEN '010' WHEN 'click' THEN '043' WHEN 'signup' THEN '050'
         WHEN 'purchase' THEN '112' ELSE '190' END AS cameo_code,
       CAST(1 + event_id % 3 AS INTEGER) AS num_events,
       CAST(1 + user_id % 10 AS INTEGER) AS num_articles,
       CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'signup' THEN 2
         WHEN 'purchase' THEN 3 ELSE 4 END AS quad_class,
       CASE WHEN event_id % 17 = 0 THEN NULL
         ELSE (CAST(floor(value * 100) AS BIGINT) % 201 - 100) / CAST(10 AS DOUBLE)
       END AS goldstein
FROM events
"""

LINES = """
SELECT CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS event_date,
       'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS source_actor,
       'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS target_actor,
       p_type AS cameo_code,
       l_linenumber AS num_events,
       CAST(l_quantity AS INTEGER) AS num_articles,
       CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 4
         WHEN l_linestatus = 'O' THEN 2 ELSE 3 END AS quad_class,
       CASE WHEN l_partkey % 17 = 0 THEN NULL
         ELSE ((l_partkey * 7 + l_linenumber) % 201 - 100) / CAST(10 AS DOUBLE)
       END AS goldstein
FROM lineitem
LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN part ON l_partkey = p_partkey
"""

COLUMNS = (
    "globaleventid, event_date, source_actor, target_actor, cameo_code,"
    " num_events, num_articles, quad_class, goldstein"
)

KEYS = {
    "quad": "event_date, quad_class",
    "dyad": "event_date, source_actor, target_actor",
    "actor": "event_date, source_actor",
    "cameo": "event_date, cameo_code",
}

TABLES = {
    "quad": "daily_event_volume_by_quadclass",
    "dyad": "dyad_interactions",
    "actor": "top_actors",
    "cameo": "daily_cameo_metrics",
}

RANGE = f"event_date BETWEEN {START} AND {END}"


def _nearest(column: str) -> str:
    """The double nearest to the exact sum of a column of doubles: the sum in units of 2^-100, then
    its 62 leading bits, with a last one that says whether anything follows, are rounded once."""
    total = f"sum(CAST({column} * pow(2, 100) AS HUGEINT))"
    cut = f"greatest(length(bin(abs({total}))) - 62, 0)"
    unit = f"CAST(pow(2, {cut}) AS HUGEINT)"
    lead = f"CAST(abs({total}) // {unit} AS BIGINT) | CASE WHEN abs({total}) % {unit} = 0 THEN 0 ELSE 1 END"
    return f"(sign({total}) * CAST({lead} AS DOUBLE) * pow(2, {cut} - 100))"


ROW_MEAN = f"{_nearest('goldstein')} / nullif(count(goldstein), 0)"
MEAN_OF_MEANS = f"{_nearest('avg_goldstein')} / nullif(count(avg_goldstein), 0)"
CONFLICT = f"CAST(sum(CASE WHEN quad_class IN {CONFLICT_CLASSES} THEN total_events ELSE 0 END) AS BIGINT)"
TOTAL = "CAST(sum(total_events) AS BIGINT) AS total_events"
DAY = "CAST(strptime(CAST(event_date AS VARCHAR), '%Y%m%d') AS DATE)"
WIDTH = "(SELECT max(event_id) - min(event_id) + 1 FROM events)"


def _view(source: str, name: str) -> str:
    """A view over a table expression, as a table expression."""
    articles = (
        "" if name == "dyad" else "CAST(sum(num_articles) AS BIGINT) AS total_articles,"
    )
    return (
        f"SELECT {KEYS[name]}, CAST(sum(num_events) AS BIGINT) AS total_events, {articles}"
        f" {ROW_MEAN} AS avg_goldstein FROM ({source}) AS e GROUP BY {KEYS[name]}"
    )


def _recompute(name: str) -> str:
    keys = [k for k in KEYS[name].split(", ") if k not in ("event_date", "quad_class")]
    where = " AND ".join(f"{k} IS NOT NULL" for k in keys) or "TRUE"
    return (
        f"SELECT {KEYS[name]}, CAST(sum(num_events) AS BIGINT) AS total_events,"
        f" {ROW_MEAN} AS avg_goldstein FROM ({LINES}) AS e WHERE {where} GROUP BY {KEYS[name]}"
    )


def _over_view(
    source: str, name: str, keys: str, mean: str, where: str = "TRUE", tail: str = ""
) -> str:
    return (
        f"SELECT {keys}, {TOTAL}, {MEAN_OF_MEANS} AS {mean} FROM ({_view(source, name)}) AS v"
        f" WHERE {RANGE} AND {where} GROUP BY ALL {tail}"
    )


def _over_events(source: str, keys: str, where: str = "TRUE", tail: str = "") -> str:
    return (
        f"SELECT {keys}, CAST(sum(num_events) AS BIGINT) AS total_events,"
        f" {ROW_MEAN} AS avg_goldstein FROM ({source}) AS e"
        f" WHERE {RANGE} AND {where} GROUP BY ALL {tail}"
    )


def _top(n: int, keys: str) -> str:
    return f"ORDER BY total_events DESC, {keys} LIMIT {n}"


PAIR = "source_actor, target_actor"
COUNTRY = "source_actor IS NOT NULL AND length(source_actor) = 3"
BOTH = "source_actor IS NOT NULL AND target_actor IS NOT NULL"
LABEL = "CASE quad_class " + " ".join(f"WHEN {n} THEN '{label}'" for n, label in QUAD_LABELS.items()) + " ELSE {other} END"
TOP_DYADS = _over_view(LINES, "dyad", PAIR, "mean_goldstein", BOTH, _top(20, PAIR))

# --- the event log after changes of one kind, and after all of them ----------------------

LATE = f"""
SELECT globaleventid + {WIDTH} AS globaleventid,
       event_date - 100000 * num_events AS event_date,
       source_actor, target_actor, cameo_code, num_events, num_articles, quad_class, goldstein
FROM ev WHERE cameo_code = '010'
"""

RESCORED = {
    "num_events": "CASE WHEN cameo_code = '112' THEN num_events + 1 ELSE num_events END",
    "goldstein": "CASE WHEN cameo_code = '112' THEN coalesce(-goldstein, 1.0) ELSE goldstein END",
}
MOVED = {
    "source_actor": "CASE WHEN cameo_code = '043' THEN target_actor ELSE source_actor END",
    "target_actor": "CASE WHEN cameo_code = '043' THEN source_actor ELSE target_actor END",
    "cameo_code": "CASE WHEN cameo_code = '043' THEN '042' ELSE cameo_code END",
    "quad_class": "CASE WHEN cameo_code = '043' THEN 2 ELSE quad_class END",
}
UNSCORED = {"goldstein": "CASE WHEN cameo_code = '050' THEN NULL ELSE goldstein END"}
ALL_NEW = {
    **MOVED,
    "num_events": RESCORED["num_events"],
    "goldstein": "CASE WHEN cameo_code = '112' THEN coalesce(-goldstein, 1.0)"
    " WHEN cameo_code = '050' THEN NULL ELSE goldstein END",
}


def _changed(new: dict[str, str], where: str = "TRUE", late: bool = False) -> str:
    columns = ", ".join(
        f"{new[c]} AS {c}" if c in new else c for c in COLUMNS.split(", ")
    )
    more = f" UNION ALL {LATE}" if late else ""
    return f"WITH ev AS ({EVENT_LOG}) SELECT {columns} FROM ev WHERE {where}{more}"


AFTER_ALL = _changed(ALL_NEW, "cameo_code <> '190'", late=True)

INCOMING = f"""
SELECT globaleventid, event_date, source_actor, target_actor, cameo_code,
       num_events + 1 AS num_events, num_articles, quad_class,
       coalesce(-goldstein, 1.0) AS goldstein
FROM ev WHERE cameo_code = '112'
UNION ALL {LATE}
"""

COPIED = f"""
SELECT globaleventid + g * {WIDTH} AS globaleventid, globaleventid AS template_id, event_date,
       source_actor, target_actor, cameo_code, num_events, num_articles, quad_class, goldstein
FROM ({EVENT_LOG}) AS ev, generate_series(1, {COPIES}) AS s(g)
"""

# --- signed rows of each batch of the change stream (for the number of changed groups) ---

TOUCHED = f"""
WITH ev AS ({EVENT_LOG}),
after_moves AS (
  SELECT event_date, target_actor AS source_actor, source_actor AS target_actor,
         '042' AS cameo_code, 2 AS quad_class, cameo_code AS was
  FROM ev WHERE cameo_code IN ('043', '112')
),
touched AS (
  SELECT 0 AS batch_id, event_date, quad_class, source_actor, target_actor, cameo_code FROM ev
  UNION ALL
  SELECT 1, event_date, quad_class, source_actor, target_actor, cameo_code
  FROM ev WHERE cameo_code <> '010'
  UNION ALL
  SELECT 1, event_date, quad_class, source_actor, target_actor, cameo_code FROM after_moves
  UNION ALL
  SELECT 1, event_date, quad_class, source_actor, target_actor, cameo_code FROM ({LATE}) AS late
)
"""


def _touched_counts() -> str:
    parts = [
        f"SELECT batch_id, '{name}' AS view, count(DISTINCT ({keys})) AS keys_changed"
        " FROM touched GROUP BY batch_id"
        for name, keys in KEYS.items()
    ]
    return f"{TOUCHED} {' UNION ALL '.join(parts)}"


def _timed_view(name: str) -> str:
    """A view after all changes, with the time of the last batch that touched each group."""
    keys = KEYS[name]
    last = f"SELECT {keys}, max(batch_id) AS batch_id FROM touched GROUP BY {keys}"
    return (
        f"{TOUCHED}, last AS ({last}), changed AS ({_view(AFTER_ALL, name)})"
        f" SELECT changed.*, CAST({FIRST_COMMIT_S} + 3600 * last.batch_id AS BIGINT) AS updated_at_s"
        f" FROM changed JOIN last USING ({keys})"
    )


# --- text files --------------------------------------------------------------------------


def _placed(geo: Callable[[str], str]) -> str:
    """The position columns as they are put into text files and the stored table."""
    return f"""
           CAST({geo("1")} AS INTEGER) AS source_geo_type,
           CAST({geo("num_articles * CAST(1.5 AS DOUBLE)")} AS DOUBLE) AS source_geo_lat,
           CAST({geo("num_articles * CAST(-2.25 AS DOUBLE)")} AS DOUBLE) AS source_geo_long,
           CAST({geo("4")} AS INTEGER) AS target_geo_type,
           CAST({geo("num_events * CAST(0.5 AS DOUBLE)")} AS DOUBLE) AS target_geo_lat,
           CAST(NULL AS DOUBLE) AS target_geo_long,
           quad_class AS action_geo_type,
           num_articles + CAST(0.25 AS DOUBLE) AS action_geo_lat,
           CAST(-3.0 AS DOUBLE) AS action_geo_long
    """


def _text(short_layout: bool) -> str:
    """What is stored from the text files: source and target positions are lost with the
    short layout, and for lines written in it."""

    def geo(expression: str) -> str:
        if short_layout:
            return "NULL"
        return f"CASE WHEN cameo_code = '043' THEN NULL ELSE {expression} END"

    return f"""
    SELECT event_date, source_actor, target_actor, cameo_code, num_events, num_articles,
           quad_class, goldstein, {_placed(geo)}
    FROM ({EVENT_LOG}) AS ev WHERE cameo_code <> '190'
    """


KEPT_LINES = "(SELECT count(*) FROM events WHERE event_type <> 'error')"
LAST_ID = "(SELECT max(event_id) FROM events)"


def _kpis(view: str) -> str:
    return f"""
    SELECT coalesce(CAST(sum(total_events) AS BIGINT), 0) AS total_events,
           coalesce({CONFLICT}, 0) AS conflict_events,
           coalesce({MEAN_OF_MEANS}, 0.0) AS mean_goldstein,
           CASE WHEN coalesce(sum(total_events), 0) = 0 THEN 0.0
             ELSE CAST({CONFLICT} AS DOUBLE) / CAST(sum(total_events) AS DOUBLE) * 100.0
           END AS conflict_rate
    FROM ({view}) AS v WHERE {RANGE}
    """


def _diff(c: str) -> str:
    return (
        f"coalesce(b.{c}, 0) AS {c}_before, coalesce(a.{c}, 0) AS {c}_after,"
        f" coalesce(a.{c}, 0) - coalesce(b.{c}, 0) AS {c}_diff"
    )


def oracles() -> dict[str, str]:
    """SQL by query name."""
    sql: dict[str, str] = {}
    for name in KEYS:
        sql[f"view_{name}"] = _view(LINES, name)
        sql[f"recompute_{name}"] = _recompute(name)
        sql[f"changelog_delta_{name}"] = _view(AFTER_ALL, name)
        sql[f"stream_view_{name}"] = _timed_view(name)

    sql["date_bounds"] = f"""
    SELECT *, CAST(strptime(CAST(min_event_date AS VARCHAR), '%Y%m%d') AS DATE) AS min_day,
           CAST(strptime(CAST(max_event_date AS VARCHAR), '%Y%m%d') AS DATE) AS max_day,
           date_diff('day', CAST(strptime(CAST(max_event_date AS VARCHAR), '%Y%m%d') AS DATE),
                     DATE '{AS_OF}') <= 7 AS is_live
    FROM (SELECT min(event_date) AS min_event_date, max(event_date) AS max_event_date
          FROM ({EVENT_LOG}) AS ev) AS m
    """
    sql["kpis"] = _kpis(_view(LINES, "quad"))
    sql["trend"] = f"""
    SELECT {DAY} AS event_day, {TOTAL}, {CONFLICT} AS conflict_events,
           {MEAN_OF_MEANS} AS mean_goldstein
    FROM ({_view(LINES, "quad")}) AS v WHERE {RANGE} GROUP BY event_date
    """
    sql["top_actors_iso"] = _over_view(
        EVENT_LOG,
        "actor",
        "source_actor AS iso3",
        "mean_goldstein",
        COUNTRY,
        f"HAVING sum(total_events) > 0 {_top(250, 'iso3')}",
    )
    sql["top_dyads"] = TOP_DYADS
    sql["top_cameo"] = _over_view(
        LINES,
        "cameo",
        "cameo_code",
        "mean_goldstein",
        "cameo_code IS NOT NULL",
        _top(20, "cameo_code"),
    )
    sql["quad_dist"] = f"""
    SELECT *, {LABEL.format(other="CAST(quad_class AS VARCHAR)")} AS quad_label
    FROM ({_over_view(LINES, "quad", "quad_class", "avg_goldstein")}) AS d
    """
    sql["quad_time"] = f"""
    SELECT {DAY} AS event_day, quad_class, {TOTAL},
           {LABEL.format(other="'Q' || CAST(quad_class AS VARCHAR)")} AS quad_label
    FROM ({_view(LINES, "quad")}) AS v WHERE {RANGE} GROUP BY event_date, quad_class
    """
    sql["dyad_heatmap"] = f"""
    WITH dyads AS ({TOP_DYADS}),
    ends AS (SELECT source_actor AS a FROM dyads UNION ALL SELECT target_actor FROM dyads),
    busiest AS (SELECT a FROM ends GROUP BY a ORDER BY count(*) DESC, a LIMIT 12)
    SELECT source_actor, target_actor, {TOTAL} FROM dyads
    WHERE source_actor IN (SELECT a FROM busiest) AND target_actor IN (SELECT a FROM busiest)
    GROUP BY source_actor, target_actor
    """
    sql["raw_daily"] = _over_events(LINES, "event_date, quad_class")
    sql["raw_actors"] = _over_events(
        EVENT_LOG, "source_actor", COUNTRY, _top(250, "source_actor")
    )
    sql["raw_dyads"] = _over_events(LINES, PAIR, BOTH, _top(50, PAIR))
    sql["raw_cameo"] = _over_events(
        LINES, "cameo_code", "cameo_code IS NOT NULL", _top(50, "cameo_code")
    )
    sql["rollup_daily"] = _over_view(LINES, "quad", "event_date, quad_class", "avg_goldstein")
    sql["rollup_actors"] = _over_view(
        EVENT_LOG, "actor", "source_actor", "avg_goldstein", COUNTRY, _top(250, "source_actor")
    )
    sql["rollup_dyads"] = _over_view(LINES, "dyad", PAIR, "avg_goldstein", BOTH, _top(50, PAIR))
    sql["rollup_cameo"] = _over_view(
        LINES,
        "cameo",
        "cameo_code",
        "avg_goldstein",
        "cameo_code IS NOT NULL",
        _top(50, "cameo_code"),
    )
    sql["view_counts"] = " UNION ALL ".join(
        f"SELECT '{TABLES[name]}' AS table_name, count(*) AS n_rows"
        f" FROM ({_view(EVENT_LOG, name)}) AS v"
        for name in KEYS
    )
    sql["sql_report"] = f"""
    WITH quad AS ({_view(EVENT_LOG, "quad")})
    SELECT * FROM quad
    WHERE event_date = (SELECT max(event_date) FROM quad) AND quad_class = 1 AND {RANGE}
    """

    sql["update_by_key"] = _changed(RESCORED)
    sql["delete_by_keys"] = _changed({}, "cameo_code <> '190'")
    sql["rows_by_keys"] = _changed({}, "cameo_code = '190'")
    sql["insert_ignore"] = _changed({}, late=True)
    sql["upsert_by_key"] = f"""
    WITH ev AS ({EVENT_LOG}), incoming AS ({INCOMING})
    SELECT ev.* EXCLUDE (num_events, goldstein),
           CASE WHEN i.globaleventid IS NULL THEN ev.num_events ELSE i.num_events END AS num_events,
           CASE WHEN i.globaleventid IS NULL THEN ev.goldstein ELSE i.goldstein END AS goldstein
    FROM ev LEFT JOIN incoming AS i ON i.globaleventid = ev.globaleventid
    UNION ALL BY NAME
    SELECT i.* FROM incoming AS i ANTI JOIN ev ON i.globaleventid = ev.globaleventid
    """
    sql["duplicate_keys"] = f"""
    WITH ev AS ({EVENT_LOG}), incoming AS ({INCOMING})
    SELECT globaleventid, count(*) AS n_rows
    FROM (SELECT globaleventid FROM ev UNION ALL SELECT globaleventid FROM incoming) AS u
    GROUP BY globaleventid HAVING count(*) > 1
    """
    sql["expr_update"] = _changed(
        {
            "goldstein": "CASE WHEN cameo_code = '112' THEN coalesce(goldstein, 0.0) + 1.0"
            " ELSE goldstein END"
        }
    )
    sample = f"ORDER BY md5(CAST(globaleventid AS VARCHAR) || '{SEED}'), globaleventid LIMIT {SAMPLE}"
    sql["sample_keys"] = f"SELECT globaleventid FROM ({EVENT_LOG}) AS ev {sample}"
    sql["append_sample"] = f"""
    WITH ev AS ({EVENT_LOG})
    SELECT * FROM ev
    UNION ALL
    SELECT globaleventid + {LAST_ID} + {SAMPLE_SHIFT}, s.* EXCLUDE (globaleventid)
    FROM (SELECT * FROM ev {sample}) AS s
    """
    sql["replicate_rows"] = f"SELECT * EXCLUDE (template_id) FROM ({COPIED}) AS c"
    sql["id_list"] = f"""
    SELECT template_id, string_agg(CAST(globaleventid AS VARCHAR), ',' ORDER BY globaleventid)
           AS id_list
    FROM ({COPIED}) AS c GROUP BY template_id
    """
    sql["id_pieces"] = f"""
    SELECT cameo_code, (n - 1) // 100 AS piece, string_agg(CAST(globaleventid AS VARCHAR), ',' ORDER BY globaleventid) AS id_list
    FROM (SELECT cameo_code, globaleventid, row_number() OVER (PARTITION BY cameo_code ORDER BY globaleventid) AS n
          FROM ({EVENT_LOG}) AS ev) AS numbered
    GROUP BY cameo_code, piece
    """
    sql["parse_ids"] = f"SELECT template_id, globaleventid FROM ({COPIED}) AS c"
    sql["scalar_fns"] = f"""
    SELECT globaleventid, {DAY} AS event_day,
           CAST(strftime({DAY} + INTERVAL 7 DAY, '%Y%m%d') AS INTEGER) AS week_later,
           CAST(event_date AS VARCHAR) AS date_text,
           CAST(num_events AS BIGINT) AS num_events_long,
           CAST(length(source_actor) AS INTEGER) AS source_length,
           coalesce(goldstein, 0.0) AS score_or_zero,
           greatest(goldstein, 0.0) AS score_at_least_zero,
           source_actor || ',' || target_actor AS pair,
           CASE WHEN num_articles - 1 = 0 THEN 0.0
             ELSE CAST(num_events AS DOUBLE) / CAST(num_articles - 1 AS DOUBLE) * 100.0 END AS share,
           globaleventid + {SAMPLE_SHIFT} AS shifted_id
    FROM ({EVENT_LOG}) AS ev
    """

    sql["value_update"] = _view(_changed(RESCORED), "quad")
    sql["group_move"] = _view(_changed(MOVED), "dyad")
    sql["null_scores"] = _view(_changed(UNSCORED), "cameo")
    sql["vanishing_group"] = _view(_changed({}, "cameo_code <> '190'"), "cameo")
    sql["late_inserts"] = _view(_changed({}, late=True), "actor")
    sql["net_nothing"] = _view(EVENT_LOG, "quad")
    sql["changed_table"] = AFTER_ALL
    sql["snapshot_diff"] = f"""
    WITH b AS ({_view(EVENT_LOG, "cameo")}), a AS ({_view(AFTER_ALL, "cameo")})
    SELECT coalesce(a.event_date, b.event_date) AS event_date,
           coalesce(a.cameo_code, b.cameo_code) AS cameo_code,
           {_diff("total_events")}, {_diff("total_articles")},
           CASE WHEN b.event_date IS NULL THEN 'added' WHEN a.event_date IS NULL THEN 'removed'
             WHEN a.total_events = b.total_events AND a.total_articles = b.total_articles
               AND a.avg_goldstein IS NOT DISTINCT FROM b.avg_goldstein THEN 'same'
             ELSE 'changed' END AS status
    FROM b FULL JOIN a ON a.event_date = b.event_date AND a.cameo_code = b.cameo_code
    """
    sql["reconcile_key"] = f"""
    SELECT event_date, quad_class,
           total_events AS total_events_before, total_events + 3 AS total_events_after,
           CAST(3 AS BIGINT) AS total_events_diff,
           total_articles AS total_articles_before, total_articles + 3 AS total_articles_after,
           CAST(3 AS BIGINT) AS total_articles_diff
    FROM ({_view(EVENT_LOG, "quad")}) AS v
    """

    sql["heatmap_grid"] = f"""
    WITH cells AS ({sql["dyad_heatmap"]})
    SELECT s.source_actor, t.target_actor, CAST(coalesce(sum(c.total_events), 0) AS BIGINT) AS total_events
    FROM (SELECT DISTINCT source_actor FROM cells) AS s
      CROSS JOIN (SELECT DISTINCT target_actor FROM cells) AS t
      LEFT JOIN cells AS c ON c.source_actor = s.source_actor AND c.target_actor = t.target_actor
    GROUP BY s.source_actor, t.target_actor
    """
    sql["load_text_late_layout"] = sql["load_text_repeats"] = _text(short_layout=False)
    sql["load_text"] = sql["load_slices"] = _text(short_layout=False)
    sql["load_text_short"] = _text(short_layout=True)
    sql["load_ids"] = f"""
    SELECT {KEPT_LINES} AS n_rows, {LAST_ID} + 1 AS first_id, {LAST_ID} + {KEPT_LINES} AS last_id,
           CAST({KEPT_LINES} * {LAST_ID} + {KEPT_LINES} * ({KEPT_LINES} + 1) // 2 AS BIGINT) AS sum_ids
    """
    sql["line_report"] = """
    SELECT CAST(n AS INTEGER) AS n_fields, count(*) AS n_lines, n <> 12 AS loaded
    FROM (SELECT CASE event_type WHEN 'error' THEN 12 WHEN 'click' THEN 11 ELSE 17 END AS n
          FROM events) AS t
    GROUP BY n
    """
    sql["stored_table"] = f"""
    SELECT *, {_placed(lambda expression: expression)}
    FROM ({_changed({}, late=True)}) AS t WHERE {RANGE}
    """
    sql["stream_text"] = _view(_changed({}, "cameo_code <> '190'"), "quad")
    sql["stream_ids"] = f"""
    SELECT {KEPT_LINES} AS n_rows, {KEPT_LINES} AS n_ids, CAST(1 AS BIGINT) AS first_id, {KEPT_LINES} AS last_id,
           CAST({KEPT_LINES} * ({KEPT_LINES} + 1) // 2 AS BIGINT) AS sum_ids
    """
    sql["stream_rejects"] = f"""
    SELECT CASE WHEN cameo_code = '190' THEN 'bad num_events' ELSE CAST(quad_class AS VARCHAR) END AS kind,
           count(*) AS n_lines
    FROM ({EVENT_LOG}) AS ev GROUP BY kind
    """
    sql["stream_table"] = sql["compacted_table"] = AFTER_ALL
    sql["stream_table_views"] = sql["crash_replay_views"] = " UNION ALL ".join(
        f"SELECT '{name}' AS view, count(*) AS n_groups, count(*) AS n_alike FROM ({_view(AFTER_ALL, name)}) AS v"
        for name in KEYS
    )
    sql["crash_replay_dyad"] = _timed_view("dyad")
    sql["compacted_cameo_range"] = f"SELECT * FROM ({_view(AFTER_ALL, 'cameo')}) AS v WHERE event_date BETWEEN 20240101 AND 20240131"
    appended = sql["append_sample"]
    sql["stream_append"] = f"""
    WITH b AS ({_view(EVENT_LOG, "quad")}), a AS ({_view(appended, "quad")})
    SELECT event_date, quad_class, {_diff("total_events")}, {_diff("total_articles")},
           CASE WHEN b.total_events = a.total_events AND b.total_articles = a.total_articles
               AND a.avg_goldstein IS NOT DISTINCT FROM b.avg_goldstein THEN 'same' ELSE 'changed' END AS status
    FROM b JOIN a USING (event_date, quad_class)
    """
    sql["stream_sql"] = f"""
    WITH days AS (SELECT event_date, {TOTAL} FROM ({_view(AFTER_ALL, "quad")}) AS q WHERE {RANGE} GROUP BY event_date),
    codes AS ({_view(AFTER_ALL, "cameo")})
    SELECT event_date, days.total_events, cameo_code FROM days JOIN codes USING (event_date)
    QUALIFY row_number() OVER (PARTITION BY event_date ORDER BY codes.total_events DESC, cameo_code DESC) = 1
    """
    sql["seeded_table"] = f"""
    WITH seed AS (SELECT * FROM (VALUES
      (1, 19790101, 'AFR', 'FRA', '043', 1, 4, 1, CAST(2.8 AS DOUBLE)), (2, 19790101, 'AFR', 'FRA', '050', 2, 9, 1, 3.5),
      (3, 19790101, 'ARG', 'CHL', '172', 2, 4, 4, -5.0), (4, 19790101, 'CHN', 'CHNGOV', '0841', 1, 6, 2, 7.0)) AS t({COLUMNS}))
    SELECT * FROM ({EVENT_LOG}) AS ev WHERE globaleventid > 2
    UNION ALL SELECT * FROM seed WHERE globaleventid NOT IN (SELECT event_id FROM events WHERE event_id > 2)
    """
    digits = """CASE globaleventid % 4 WHEN 0 THEN goldstein / CAST(7.0 AS DOUBLE) WHEN 1 THEN goldstein * CAST(1e-11 AS DOUBLE)
      WHEN 2 THEN goldstein * CAST(2500.0 AS DOUBLE) / CAST(3.0 AS DOUBLE) ELSE goldstein END"""
    sql["exact_scores"] = _view(_changed({"goldstein": digits}, "globaleventid % 2 = 0"), "quad")
    sql["stream_notices"] = _touched_counts()
    sql["stream_freshness"] = f"""
    SELECT view, max(batch_id) AS last_batch, max(batch_id) > 0 AS updated,
           CAST({FIRST_COMMIT_S} + 3600 * max(batch_id) AS BIGINT) AS updated_at_s
    FROM ({_touched_counts()}) AS t WHERE keys_changed > 0 GROUP BY view
    """
    sql["stream_kpis"] = _kpis(_view(AFTER_ALL, "quad"))
    sql["stream_top_dyads"] = _over_view(
        AFTER_ALL, "dyad", PAIR, "mean_goldstein", BOTH, _top(20, PAIR)
    )
    sql["compacted_dyad"] = _view(AFTER_ALL, "dyad")
    return sql
