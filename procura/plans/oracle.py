"""What the queries of the catalogue must return, in DuckDB SQL over the same tables."""

from __future__ import annotations

from procura import constants as C

ITEMS = """items AS (
  SELECT CAST(l.l_orderkey AS HUGEINT) * 10000000000000000 + l.l_linenumber * CAST(1000000000000000 AS HUGEINT)
      + l.l_partkey * CAST(100000 AS HUGEINT) + l.l_suppkey % 100000 AS ordinal,
    p.p_name AS name, s.s_name AS contractor, c.c_mktsegment AS department, 'order_' || CAST(o.o_orderkey AS VARCHAR) AS source_file,
    l.l_quantity AS quantity, l.l_extendedprice / l.l_quantity AS unit_price, l.l_extendedprice AS total_price,
    CAST(l.l_shipdate AS DATE) AS date, lower(p.p_type) AS unit, p.p_brand AS brand
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""


#: Items whose contractor is one; some are words that name none.
NAMED = ITEMS.replace("items AS (", "every AS (", 1) + ", items AS (SELECT * FROM every WHERE quantity NOT IN (7, 13, 20))"


def _mid(array: str, first: str, count: str) -> str:
    """The median of ``count`` values of a sorted list from a 0-based place on."""
    return f"(({array}[{first} + ({count} + 1) // 2] + {array}[{first} + ({count}) // 2 + 1]) / 2)"


def _stats(keys: str, value: str, source: str = "items") -> str:
    """CTEs sorted and stats: the statistics of positive values per group."""
    return f"""sorted AS (
  SELECT {keys}, list({value} ORDER BY {value}) AS s, count(*) AS n, avg({value}) AS mean, stddev_samp({value}) AS sd,
    min(round({value}, 2)) = max(round({value}, 2)) AS same
  FROM {source} WHERE {value} > 0 GROUP BY ALL
), halves AS (
  SELECT *, n // 2 AS h, {_mid("s", "0", "n")} AS median FROM sorted
), quart AS (
  SELECT *, CASE WHEN n < 2 THEN s[1] ELSE {_mid("s", "0", "h")} END AS q1, CASE WHEN n < 2 THEN s[1] ELSE {_mid("s", "(n - h)", "h")} END AS q3,
    list_sort(list_transform(s, lambda v: abs(v - median))) AS away FROM halves
), spread AS (
  SELECT *, CASE WHEN n < 2 THEN 0.0 WHEN q3 > q1 THEN q3 - q1 WHEN same THEN 0.0
    WHEN {_mid("away", "0", "n")} > 0 THEN {_mid("away", "0", "n")} * 1.4826 ELSE median * 0.1 END AS iqr FROM quart
), stats AS (
  SELECT *, q1 - 1.5 * iqr AS soft_lo, q3 + 1.5 * iqr AS soft_hi, q1 - 3.0 * iqr AS hard_lo, q3 + 3.0 * iqr AS hard_hi FROM spread
)"""


CLASS = """CASE WHEN st.n < 2 OR x.unit_price <= 0 OR iqr = 0 THEN 'insufficient_data'
  WHEN x.unit_price < hard_lo OR x.unit_price > hard_hi THEN 'strong_outlier'
  WHEN x.unit_price < soft_lo OR x.unit_price > soft_hi THEN 'moderate_deviation' ELSE 'normal' END"""


def _level(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {least} THEN '{name}'" for least, name in C.RISK_LEVELS) + " ELSE 'LOW' END"


def _scored(keys: str, items: str = ITEMS) -> str:
    """CTEs up to scored: first item, flags, score and level of every group."""
    on = " AND ".join(f"g.{k} = {{0}}.{k}" for k in keys.split(", "))
    held = {
        "duplicate_3_plus": "nd >= 3",
        "duplicate_2": "nd = 2",
        "single_occurrence": "nd < 2 AND n_items = 1",
        "iqr_strong_outlier": "kind = 'strong_outlier'",
        "iqr_moderate_outlier": "kind = 'moderate_deviation'",
        "price_deviation_100": "legacy > 100",
        "price_deviation_50": "legacy > 50 AND legacy <= 100",
        "price_deviation_20": "legacy > 20 AND legacy <= 50",
        "split_suspected": "same_source >= 3",
        "contractor_concentration": "nc = 1 AND n_items > 1",
        "temporal_clustering": "n_items > 2 AND gap <= 3",
        "quantity_deviation_50": "n_items >= 2 AND (qmax - qmin) / qmin * 100 > 30",
        "quantity_deviation_20": "n_items >= 2 AND (qmax - qmin) / qmin * 100 > 10 AND (qmax - qmin) / qmin * 100 <= 30",
        "total_mismatch": "abs(up * q - tp) / (up * q) * 100 > 2",
        "unit_mismatch": "nu > 1",
        "total_price_deviation_40": "n_items >= 2 AND off > 40",
        "total_price_deviation_15": "n_items >= 2 AND off > 15 AND off <= 40",
    }
    off_price = " OR ".join(f"({held[f]})" for f in held if f in C.PRICE_FLAGS)
    held["round_number"] = f"NOT ({off_price}) AND ((tp >= 100000 AND tp % 100000 = 0) OR (up >= 100000 AND up % 100000 = 0))"
    flags = ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in held.items())
    weights = " + ".join(f"CASE WHEN {c} THEN {C.FLAG_WEIGHTS[f]} ELSE 0 END" for f, c in held.items())
    own_file = "" if "source_file" in keys else "arg_min(source_file, ordinal) AS source_file,"
    gap = f"SELECT {keys}, min(gap) AS gap FROM (SELECT {keys}, date - lag(date) OVER (PARTITION BY {keys} ORDER BY date) AS gap FROM items) GROUP BY ALL"
    return f"""{items}, {_stats(keys, "unit_price")}, grouped AS (
  SELECT {keys}, count(*) AS n_items, count(DISTINCT department) AS nd, count(DISTINCT contractor) AS nc, count(DISTINCT unit) AS nu,
    min(quantity) AS qmin, max(quantity) AS qmax, list(total_price ORDER BY total_price) AS t, min(ordinal) AS first_ordinal,
    arg_min(contractor, ordinal) AS contractor, {own_file} arg_min(department, ordinal) AS department, bool_or(contains(contractor, '1')) AS any1, arg_min(quantity, ordinal) AS q,
    arg_min(unit_price, ordinal) AS up, arg_min(total_price, ordinal) AS tp
  FROM items GROUP BY {keys}
), same AS (SELECT {keys}, source_file AS sf, count(*) AS same_source FROM items GROUP BY ALL), gaps AS ({gap}), judged AS (
  SELECT g.*, same_source, gap, round(abs((tp - {_mid("t", "0", "n_items")}) / {_mid("t", "0", "n_items")} * 100), 2) AS off,
    CASE WHEN st.n < 3 OR iqr = 0 THEN 'insufficient_data' WHEN up < hard_lo OR up > hard_hi THEN 'strong_outlier'
      WHEN up < soft_lo OR up > soft_hi THEN 'moderate_deviation' ELSE 'normal' END AS kind,
    round(abs((up - round(median, 2)) / round(median, 2) * 100), 2) AS dev, st.n AS n_prices
  FROM grouped g JOIN stats st ON {on.format("st")} JOIN same ON {on.format("same")} AND g.source_file = same.sf JOIN gaps ON {on.format("gaps")}
), legs AS (
  SELECT *, CASE WHEN kind IN ('strong_outlier', 'moderate_deviation') OR n_prices < 2 THEN 0 ELSE dev END AS legacy FROM judged
), scored AS (
  SELECT *, least({weights}, 100) AS score, array_to_string(list_filter([{flags}], lambda f: f IS NOT NULL), ',') AS flags FROM legs
)"""


RAW = """raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, '  ' || p_name || '  10 шт' AS name,
    CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE replace(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), '.', ',') END AS quantity,
    CASE WHEN l_orderkey % 3 = 0 THEN 'ШТ.' WHEN l_orderkey % 3 = 1 THEN 'kg' ELSE 'услуга' END AS unit,
    CASE WHEN l_orderkey % 11 = 0 THEN l_partkey END AS price, CASE WHEN l_orderkey % 22 = 0 THEN l_partkey + 7 END AS amount,
    CASE WHEN l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 THEN NULL ELSE CAST(l_extendedprice AS VARCHAR) END AS total_price,
    CASE WHEN l_orderkey % 2 = 0 OR l_orderkey % 11 = 0 THEN '-5' ELSE CAST(l_partkey AS VARCHAR) END AS unit_price,
    CASE WHEN l_orderkey % 4 = 0 THEN '1.2.2024' WHEN l_orderkey % 4 = 1 THEN '2024/03/05' WHEN l_orderkey % 4 = 2 THEN '31.02.2024' ELSE '07-11-2023' END AS date,
    CASE WHEN l_orderkey % 6 = 0 THEN 'не указан' ELSE 'ООО «' || CAST(l_suppkey AS VARCHAR) || '»' END AS contractor
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

NORMALISED = RAW + """, n AS (
  SELECT l_orderkey, l_linenumber, l_partkey, trim(name) AS name, CAST(quantity AS DOUBLE) AS q, CAST(total_price AS DOUBLE) AS t, CAST(price AS DOUBLE) AS old, CAST(amount AS DOUBLE) AS alt,
    CASE WHEN unit_price = '-5' THEN NULL ELSE CAST(unit_price AS DOUBLE) END AS u,
    CASE unit WHEN 'ШТ.' THEN 'шт' WHEN 'kg' THEN 'кг' ELSE 'усл.' END AS unit,
    CASE WHEN date = '1.2.2024' THEN '2024-02-01' WHEN date = '2024/03/05' THEN '2024-03-05' WHEN date = '31.02.2024' THEN '' ELSE '2023-11-07' END AS date,
    CASE WHEN contractor = 'не указан' THEN '' ELSE contractor END AS contractor FROM raw
), o AS (SELECT *, old IS NOT NULL AND u IS NULL AND t IS NULL AS legacy, coalesce(alt > old, false) AS explicit, coalesce(q > 0 AND q <> 1 AND old > 0, false) AS many, coalesce(q > 0 AND q <> 1 AND old = 0, false) AS odd FROM n
), p AS (
  SELECT * REPLACE (CASE WHEN NOT legacy THEN u WHEN explicit OR many THEN old END AS u,
    CASE WHEN NOT legacy THEN t WHEN explicit THEN alt WHEN many THEN (round_even(old * q * 100, 0) / 100) ELSE old END AS t) FROM o
), a AS (SELECT *, coalesce(t IS NULL AND u <> 0 AND q > 0, false) AS rt FROM p), b AS (SELECT * REPLACE (CASE WHEN rt THEN (round_even(u * q * 100, 0) / 100) ELSE t END AS t) FROM a),
c AS (SELECT *, coalesce(u IS NULL AND t <> 0 AND q > 0, false) AS ru FROM b), d AS (SELECT * REPLACE (CASE WHEN ru THEN (round_even(t / q * 100, 0) / 100) ELSE u END AS u) FROM c),
e AS (SELECT *, coalesce(q IS NULL AND t <> 0 AND u > 0 AND (round_even(t / u * 10000, 0) / 10000) BETWEEN 0.0001 AND 1000000, false) AS rq FROM d), f AS (SELECT * REPLACE (CASE WHEN rq THEN (round_even(t / u * 10000, 0) / 10000) ELSE q END AS q) FROM e),
g AS (SELECT *, coalesce(t <> 0 AND q > 0 AND (round_even(u * q * 100, 0) / 100) > 0 AND abs((round_even(u * q * 100, 0) / 100) - t) / (round_even(u * q * 100, 0) / 100) > 0.05, false) AS mm, rt::INT + ru::INT + rq::INT AS n_restored, (legacy AND odd AND NOT explicit)::INT AS n_ambiguous FROM f),
h AS (SELECT *, greatest(0, 100 - CASE WHEN coalesce(u, 0) > 0 OR coalesce(t, 0) > 0 THEN 0 ELSE 25 END - least(20, 10 * n_restored) - least(15, 5 * (mm::INT + n_ambiguous))
  - CASE WHEN coalesce(u, 0) > 0 AND coalesce(q, 0) = 0 THEN 5 ELSE 0 END) / 100 AS confidence FROM g)"""

VERDICTS = """log AS (
  SELECT event_id AS seq, p_name AS item_name, ['valid', 'false_positive', 'confirmed_fraud'][CAST(event_id % 3 AS INTEGER) + 1] AS verdict,
    ['flag_' || CAST(event_id % 4 AS VARCHAR), 'flag_' || CAST(user_id % 3 AS VARCHAR)] AS flags
  FROM events JOIN part ON p_partkey = event_id % 150 + 1
)"""


def _explained(scored: str) -> str:
    """Flags in the order of their explanation, and the texts that hold no amounts."""
    from procura.operators.explain import INTERPRETATION

    order = "[" + ", ".join(f"'{f}'" for f in C.FLAG_PRIORITY) + "]"
    texts = {
        "single_occurrence": "'Нет базы сравнения — 1 наблюдение'",
        "duplicate_2": "'Закупается в 2 подразделениях'",
        "duplicate_3_plus": "'Закупается в ' || CAST(nd AS VARCHAR) || ' подразделениях (норма: 1–2)'",
        "split_suspected": "'Повторений в одном источнике: ' || CAST(same_source AS VARCHAR) || ' (норма: 1)'",
        "contractor_concentration": "'Единственный поставщик для всей группы документов'",
        "unit_mismatch": "CAST(nu AS VARCHAR) || ' различных единиц (ожидается 1)'",
        "temporal_clustering": "'Несколько закупок с интервалом ≤3 дней'",
    }
    said = ", ".join(f"CASE WHEN list_contains(held, '{f}') THEN {texts[f]} || ': {INTERPRETATION[f]}' END" for f in C.FLAG_PRIORITY if f in texts)
    return f"""WITH {scored}, x AS (SELECT *, list_filter({order}, lambda f: list_contains(string_split(flags, ','), f)) AS held FROM scored)
        SELECT name, brand, score, CAST(len(held) AS INTEGER) AS n_explained, array_to_string(held, ',') AS flag_order, array_to_string(list_filter([{said}], lambda t: t IS NOT NULL), '; ') AS said,
          CAST(greatest(1, least(4, len(held))) AS INTEGER) AS n_parts FROM x"""


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _betweenness() -> str:
    """``between_``: shares of all shortest paths: their numbers level by level, up to the six steps that the network needs."""
    levels = ["l0 AS (SELECT id AS s, id AS v, 1.0::DOUBLE AS paths FROM n)", "r0 AS (SELECT s, v, paths, 0 AS depth FROM l0)"]
    for k in range(1, 7):
        levels.append(f"l{k} AS (SELECT l.s, u.b AS v, sum(l.paths) AS paths FROM l{k - 1} l JOIN u ON l.v = u.a WHERE (l.s, u.b) NOT IN (SELECT s, v FROM r{k - 1}) GROUP BY ALL)")
        levels.append(f"r{k} AS (SELECT * FROM r{k - 1} UNION ALL SELECT s, v, paths, {k} FROM l{k})")
    return f"""{ITEMS}, e AS (SELECT DISTINCT 'item:' || name AS a, unnest(['dept:' || department, 'contractor:' || contractor]) AS b FROM items),
        u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), n AS MATERIALIZED (SELECT DISTINCT a AS id FROM u), {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in levels)},
        c AS (SELECT x.v AS id, sum(x.paths * y.paths / z.paths) AS total FROM r6 x JOIN r6 y ON x.v = y.s JOIN r6 z ON z.s = x.s AND z.v = y.v
          WHERE x.depth + y.depth = z.depth AND x.v <> x.s AND x.v <> y.v GROUP BY x.v),
        between_ AS MATERIALIZED (SELECT n.id, round(coalesce(total, 0) / (((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2)), 4) AS centrality FROM n LEFT JOIN c ON n.id = c.id)"""


#: Bits of the places in text ``a`` of every letter of ``b``, folded as the bit-parallel longest common subsequence is.
LCS = """len(a) - bit_count(list_reduce(list_transform(string_split(b, ''), lambda c: list_sum(list_transform(range(len(a)), lambda i: CASE WHEN a[i + 1] = c THEN 1::HUGEINT << CAST(i AS INTEGER) ELSE 0 END))::HUGEINT),
  lambda f, m: ((f + (f & m)) | (f - (f & m))) & ((1::HUGEINT << CAST(len(a) AS INTEGER)) - 1), (1::HUGEINT << CAST(len(a) AS INTEGER)) - 1))"""
RATIO = f"""names AS (SELECT DISTINCT p_name AS name, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS t FROM part),
  pairs AS (SELECT x.name AS x, y.name AS y, x.t AS a, y.t AS b FROM names x JOIN names y ON x.name < y.name), ratios AS (SELECT x, y, a, b, 200.0 * ({LCS}) / (len(a) + len(b)) AS score FROM pairs)"""


def oracles() -> dict[str, str]:
    by_name, by_brand = _scored("name"), _scored("name, brand")
    split = ", ".join(f"({t})" for t in C.SPLIT_THRESHOLDS)
    out = {
        "procurement_items": f"WITH {ITEMS} SELECT name, contractor, department, source_file, quantity, unit_price, total_price, date, unit, brand FROM items",
        "group_price_stats": f"""WITH {ITEMS}, {_stats("name", "unit_price")}
            SELECT name, n, round(mean, 4) AS mean, median, s[1] AS min, s[n] AS max, round(sd, 4) AS stdev, CASE WHEN n > 1 THEN round(sd / mean * 100, 1) ELSE 0 END AS cv, q1, q3, iqr, soft_lo AS fence_soft_lo,
              soft_hi AS fence_soft_hi, hard_lo AS fence_hard_lo, hard_hi AS fence_hard_hi, n < 3 OR iqr = 0 AS insufficient_for_iqr FROM stats""",
        "document_price_stats": f"""WITH {ITEMS}, {_stats("source_file", "unit_price")}
            SELECT source_file, n, median, q1, q3, iqr, n < 3 OR iqr = 0 AS insufficient_for_iqr FROM stats""",
        "outlier_counts": f"""WITH {ITEMS}, {_stats("name", "unit_price")}, c AS (
              SELECT x.name, {CLASS} AS classification, x.unit_price < median AS low, iqr, round(abs(x.unit_price - median), 2) AS away, round(abs(x.unit_price - median) / median * 100, 2) AS pct,
                round((x.unit_price - mean) / sd, 2) AS z FROM items x JOIN stats st ON x.name = st.name
            ) SELECT name, classification, CASE WHEN iqr = 0 THEN 'iqr_zero' WHEN classification = 'strong_outlier' THEN if(low, 'outlier_low', 'outlier_high')
                WHEN classification = 'moderate_deviation' THEN if(low, 'below_fence', 'above_fence') ELSE 'in_range' END AS iqr_position,
              count(*) AS n_items, max(away) AS max_away, max(pct) AS max_pct, max(z) AS max_z FROM c GROUP BY ALL""",
        "price_analysis": f"""WITH {ITEMS}, {_stats("name, brand", "unit_price")}, c AS (
              SELECT x.name, x.brand, count(*) FILTER ({CLASS} = 'strong_outlier') AS outlier_count, count(*) FILTER ({CLASS} = 'moderate_deviation') AS deviation_count
              FROM items x JOIN stats st ON x.name = st.name AND x.brand = st.brand WHERE st.n >= 2 GROUP BY ALL
            ), r AS (
              SELECT name, brand, unit_price AS p, row_number() OVER (PARTITION BY name, brand ORDER BY date, ordinal) AS rn, count(*) OVER (PARTITION BY name, brand) AS n FROM items
            ), t AS (SELECT name, brand, avg(p) FILTER (rn <= greatest(1, n // 3)) AS a, avg(p) FILTER (rn > n - greatest(1, n // 3)) AS b FROM r WHERE n >= 3 GROUP BY ALL),
            u AS (SELECT name, brand, round((b - a) / a * 100, 1) AS change_pct FROM t)
            SELECT s.name, s.brand, s.n, coalesce(outlier_count, 0) AS outlier_count, coalesce(deviation_count, 0) AS deviation_count,
              CASE WHEN change_pct > 15 THEN 'growing' WHEN change_pct < -15 THEN 'declining' WHEN change_pct IS NOT NULL THEN 'stable' END AS direction, change_pct,
              CASE WHEN s.n > 1 THEN round(sd / mean * 100, 1) ELSE 0 END > 30 AS cv_signal
            FROM stats s LEFT JOIN c ON s.name = c.name AND s.brand = c.brand LEFT JOIN u ON s.name = u.name AND s.brand = u.brand""",
        "inconsistent_items": f"""WITH {ITEMS}, o AS (SELECT name, brand, quantity * unit_price AS e, CASE WHEN quantity % 5 = 0 THEN total_price * 1.25::DOUBLE ELSE total_price END AS t FROM items)
            SELECT name, brand, count(*) AS n_items, min(round(abs(e - t) / t * 100, 1)) AS diff_pct FROM o WHERE abs(e - t) / t > 0.05 GROUP BY ALL""",
        "price_trend": f"""WITH {ITEMS}, r AS (
              SELECT name, unit_price AS p, date, row_number() OVER (PARTITION BY name ORDER BY date, ordinal) AS rn, count(*) OVER (PARTITION BY name) AS n FROM items
            ), t AS (SELECT name, avg(p) FILTER (rn <= greatest(1, n // 3)) AS a, avg(p) FILTER (rn > n - greatest(1, n // 3)) AS b, min(date) AS date_from, max(date) AS date_to, max(n) AS n FROM r WHERE n >= 3 GROUP BY name)
            SELECT name, CASE WHEN round((b - a) / a * 100, 1) > 15 THEN 'growing' WHEN round((b - a) / a * 100, 1) < -15 THEN 'declining' ELSE 'stable' END AS direction,
              round((b - a) / a * 100, 1) AS change_pct, date_from, date_to, n AS observations FROM t""",
        "total_anomalies": f"""WITH {ITEMS}, m AS (SELECT name, brand, median(total_price) AS med, count(*) AS c FROM items GROUP BY ALL HAVING count(*) >= 3)
            SELECT i.name, i.brand, i.total_price, i.source_file FROM items i JOIN m ON i.name = m.name AND i.brand = m.brand WHERE i.total_price > 3 * med""",
        "score_groups": f"""WITH {by_brand} SELECT name, brand, n_items, score, {_level("score")} AS risk_level, flags FROM scored""",
        "risk_distribution": f"""WITH {by_brand} SELECT {_level("score")} AS risk_level, count(*) AS n_groups, round(avg(score), 4) AS mean_score FROM scored GROUP BY ALL""",
        "top_risks": f"""WITH {by_name} SELECT name, score, {_level("score")} AS risk_level, flags FROM scored ORDER BY score DESC, first_ordinal LIMIT 10""",
        "results_filter": f"""WITH {_scored("name, brand, source_file")} SELECT name, brand, source_file, score FROM scored WHERE score BETWEEN 5 AND 90 AND any1""",
        "report_table": f"""WITH {by_name} SELECT name, contractor, tp AS total_price, score, {_level("score")} AS risk_level, true AS explained FROM scored""",
        "explained_groups": _explained(by_brand),
        "odd_flags": f"""WITH {ITEMS}, o AS (
              SELECT * REPLACE (CASE WHEN quantity = 4 THEN 'Прочие работы' ELSE name END AS name, CASE WHEN quantity = 1 THEN 0 ELSE unit_price END AS unit_price,
                CASE WHEN quantity = 2 THEN 0 WHEN quantity = 3 THEN NULL ELSE quantity END AS quantity) FROM items
            ), g AS (SELECT name, brand, contractor, count(*) AS n_items, arg_min(struct_pack(q := quantity, u := unit_price), ordinal) AS f FROM o GROUP BY name, brand, contractor)
            SELECT name, brand, contractor, n_items, array_to_string(list_filter([
                CASE WHEN name = 'Прочие работы' THEN 'vague_item' END, CASE WHEN CAST(split_part(contractor, '#', 2) AS INTEGER) % 7 = 0 THEN 'contractor_blacklist' END,
                CASE WHEN name LIKE 's%' THEN 'graph_central' END, CASE WHEN f.q > 0 AND f.u = 0 THEN 'volume_without_price' END,
                CASE WHEN f.u > 0 AND f.q = 0 THEN 'zero_quantity' END, CASE WHEN f.u > 0 AND f.q IS NULL THEN 'price_without_volume' END], lambda x: x IS NOT NULL), ',') AS flags FROM g""",
        "auto_cases": f"""WITH {by_brand}, f AS (SELECT *, CASE WHEN score >= 70 THEN 'item' ELSE 'contractor' END AS for_what FROM scored WHERE score >= 40)
            SELECT for_what AS kind, CASE WHEN for_what = 'item' THEN name ELSE contractor END AS title_key, count(*) AS n_items, max(score) AS max_score, round(sum(tp), 2) AS total,
              CASE WHEN max(score) >= 70 THEN 'critical' ELSE 'high' END AS priority
            FROM f GROUP BY for_what, title_key, CASE WHEN for_what = 'item' THEN first_ordinal END""",
        "split_purchases": f"""WITH {ITEMS}, s AS (
              SELECT concat_ws('/', name, brand, department) AS name, CAST(t AS DOUBLE) AS threshold, total_price, CASE WHEN quantity > 46 THEN date END AS date, ordinal FROM items JOIN (VALUES {split}) x(t)
              ON total_price >= t * (1 - {C.SPLIT_MARGIN}::DOUBLE) AND total_price < t
            ), g AS (SELECT *, CASE WHEN date - lag(date) OVER w > {C.SPLIT_WINDOW_DAYS} THEN 1 ELSE 0 END AS new FROM s WHERE date IS NOT NULL WINDOW w AS (PARTITION BY name, threshold ORDER BY date, ordinal)),
            i AS (SELECT *, sum(new) OVER (PARTITION BY name, threshold ORDER BY date, ordinal) AS island FROM g)
            SELECT name, threshold, 'high' AS severity, count(*) AS item_count, round(sum(total_price), 2) AS total_split, min(date) AS date_from, max(date) AS date_to
            FROM i GROUP BY name, threshold, island HAVING count(*) >= 2
            UNION ALL SELECT name, threshold, 'medium', count(*), round(sum(total_price), 2), NULL, NULL FROM s GROUP BY name, threshold HAVING count(*) >= 2 AND count(date) < 2""",
        "interval_pairs": f"""WITH {ITEMS}, d AS (
              SELECT concat_ws('/', name, brand, unit) AS item_key, date, arg_min(source_file, ordinal) AS f, arg_max(source_file, ordinal) AS l FROM items GROUP BY ALL
            ), p AS (SELECT *, lag(l) OVER w AS item1, lag(date) OVER w AS date1 FROM d WINDOW w AS (PARTITION BY item_key ORDER BY date))
            SELECT item_key, item1, f AS item2, CAST(date - date1 AS INTEGER) AS interval_days, date1, date AS date2 FROM p WHERE date - date1 BETWEEN 1 AND 7""",
        "repeated_amounts": f"""WITH {ITEMS} SELECT round(total_price, 2) AS amount, CAST(count(*) AS BIGINT) AS item_count, count(DISTINCT name) AS name_count FROM items
            WHERE total_price > 0 GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT name) >= 2""",
        "suspicious_intervals": f"""WITH {ITEMS}, d AS (SELECT DISTINCT name || brand AS name, date FROM items),
            g AS (SELECT name, date, date - lag(date) OVER (PARTITION BY name ORDER BY date) AS gap FROM d)
            SELECT name, count(*) AS pair_count, CAST(min(gap) AS INTEGER) AS least_days, max(date) AS last_date FROM g WHERE gap BETWEEN 1 AND 7 GROUP BY name""",
        "round_totals": f"""WITH {ITEMS} SELECT count(*) FILTER (v >= 10000 AND v % 10000 = 0) AS round_count, count(*) AS total_count,
              round(count(*) FILTER (v >= 10000 AND v % 10000 = 0) / count(*) * 100, 1) AS share_pct FROM (SELECT floor(total_price / 1000) * 1000 AS v FROM items) HAVING round_count >= 3""",
        "supplier_shares": f"""WITH {NAMED}, p AS (SELECT contractor, sum(total_price) AS total, count(*) AS item_count FROM items GROUP BY ALL)
            SELECT contractor, round(total, 2) AS total, item_count, round(total / sum(total) OVER () * 100, 6) AS share_pct FROM p""",
        "supplier_concentration": f"""WITH {NAMED}, p AS (SELECT contractor, sum(total_price) AS total FROM items GROUP BY ALL), s AS (SELECT total / sum(total) OVER () * 100 AS share FROM p)
            SELECT count(*) AS n_suppliers, round(sum(share * share), 6) AS hhi, round(max(share), 6) AS top_share_pct,
              CASE WHEN sum(share * share) >= 2500 THEN 'high' WHEN sum(share * share) >= 1500 THEN 'moderate' ELSE 'low' END AS level, sum(share * share) >= 2500 AS has_supplier_risk FROM s""",
        "department_concentration": f"""WITH {NAMED}, p AS (SELECT department, contractor, sum(total_price) AS total FROM items GROUP BY ALL),
            s AS (SELECT department, total / sum(total) OVER (PARTITION BY department) * 100 AS share FROM p) SELECT department, round(sum(share * share), 6) AS hhi, count(*) AS n_suppliers FROM s GROUP BY department""",
        "supplier_changes": f"""WITH {NAMED} SELECT name, brand, count(DISTINCT contractor) AS supplier_count, CASE WHEN count(DISTINCT contractor) > 2 THEN 'high' ELSE 'medium' END AS severity
            FROM items GROUP BY name, brand HAVING count(DISTINCT contractor) > 1""",
        "supplier_switches": f"""WITH {NAMED}, w AS (SELECT name, brand, contractor, lag(contractor) OVER (PARTITION BY name, brand ORDER BY date, ordinal) AS before FROM items)
            SELECT name, brand, count(*) FILTER (before <> contractor) AS switches, count(*) AS purchases FROM w GROUP BY name, brand""",
        "dominant_suppliers": f"""WITH {ITEMS}, e AS (SELECT contractor, name, sum(total_price) AS w, count(*) AS c FROM items GROUP BY ALL),
            s AS (SELECT contractor, sum(w) AS total, sum(c) AS item_count, count(*) AS distinct_items FROM e GROUP BY ALL), x AS (SELECT *, round(total / sum(total) OVER () * 100, 2) AS share_pct FROM s)
            SELECT contractor, round(total, 2) AS total, CAST(item_count AS BIGINT) AS item_count, distinct_items, share_pct, round(0.6::DOUBLE * share_pct + 0.3::DOUBLE * distinct_items, 4) AS dominance FROM x ORDER BY dominance DESC, contractor LIMIT 10""",
        "graph_edges": f"""WITH {ITEMS} SELECT 'dept:' || department AS src, 'item:' || name AS dst, CAST(count(*) AS DOUBLE) AS weight, count(*) AS item_count, 'bought' AS type FROM items GROUP BY ALL
            UNION ALL SELECT 'item:' || name, 'contractor:' || contractor, round(sum(total_price), 2), count(*), 'supplies' FROM items GROUP BY ALL
            UNION ALL SELECT 'doc:' || source_file, 'item:' || name, CAST(count(*) AS DOUBLE), count(*), 'contains' FROM items GROUP BY ALL""",
        "graph_stats": f"""WITH {ITEMS}, n AS (SELECT (SELECT count(DISTINCT name) FROM items) AS n_item, (SELECT count(DISTINCT department) FROM items) AS n_department,
              (SELECT count(DISTINCT contractor) FROM items) AS n_contractor, (SELECT count(DISTINCT source_file) FROM items) AS n_document,
              (SELECT count(*) FROM (SELECT DISTINCT department, name FROM items)) + (SELECT count(*) FROM (SELECT DISTINCT contractor, name FROM items)) + (SELECT count(*) FROM (SELECT DISTINCT source_file, name FROM items)) AS n_edges)
            SELECT n_item + n_department + n_contractor + n_document AS n_nodes, n_item, n_department, n_contractor, n_document, n_edges,
              round(n_edges / ((n_item + n_department + n_contractor + n_document) * (n_item + n_department + n_contractor + n_document - 1)), 6) AS density FROM n""",
        "graph_components": f"""WITH RECURSIVE {ITEMS}, e AS (SELECT DISTINCT 'doc:' || source_file AS a, 'item:' || concat_ws('/', name, brand, unit, contractor, CAST(year(date) AS VARCHAR)) AS b FROM items),
            u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), cc(id, comp) USING KEY (id) AS (
              SELECT DISTINCT a, a FROM u UNION SELECT u.b, min(cc.comp) FROM cc JOIN u ON cc.id = u.a JOIN recurring.cc AS old ON old.id = u.b WHERE cc.comp < old.comp GROUP BY u.b
            ), s AS (SELECT comp, count(*) AS n_nodes FROM cc GROUP BY comp) SELECT n_nodes, count(*) AS n_components FROM s GROUP BY n_nodes""",
        "shortest_path": f"""WITH RECURSIVE {ITEMS}, e AS (SELECT DISTINCT 'item:' || name AS a, unnest(['dept:' || department, 'contractor:' || contractor, 'doc:' || source_file]) AS b FROM items), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
            ends AS (SELECT min(b) AS s, max(b) AS t FROM e WHERE b LIKE 'doc:%'), walk(id, depth) USING KEY (id) AS (
              SELECT s, 0 FROM ends UNION SELECT u.b, min(walk.depth) + 1 FROM walk JOIN u ON walk.id = u.a WHERE u.b NOT IN (SELECT id FROM recurring.walk) GROUP BY u.b
            ) SELECT CAST(depth AS BIGINT) + 1 AS n_steps, s AS first, t AS last FROM walk JOIN ends ON id = t""",
        "supply_betweenness": f"WITH {_betweenness()} SELECT id, centrality FROM between_",
        "central_counts": f"""WITH {_betweenness()} SELECT count(*) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, count(*) FILTER (centrality > {C.CENTRAL}) AS high_centrality, max(centrality) AS max_centrality FROM between_""",
        "central_suppliers": f"""WITH {_betweenness()}, w AS (SELECT contractor, sum(total_price) AS total, count(*) AS item_count, count(DISTINCT name) AS distinct_items FROM items GROUP BY ALL),
            x AS (SELECT w.*, centrality, round(total / sum(total) OVER () * 100, 2) AS share_pct FROM w JOIN between_ ON id = 'contractor:' || contractor)
            SELECT contractor, round(total, 2) AS total, item_count, distinct_items, share_pct, centrality, round(0.6::DOUBLE * share_pct + 0.3::DOUBLE * distinct_items + 10 * centrality, 4) AS dominance
            FROM x ORDER BY dominance DESC, contractor LIMIT 10""",
        "network_document": f"""WITH {by_name}, k AS (SELECT 'item' AS type, name AS label, sum(total_price) AS total FROM items GROUP BY ALL
              UNION ALL SELECT DISTINCT * FROM (SELECT unnest(['contractor', 'department', 'document']) AS type, unnest([contractor, department, source_file]) AS label, 0 AS total FROM items)),
            v AS (SELECT k.*, score, {_level("score")} AS level FROM k LEFT JOIN scored ON k.type = 'item' AND k.label = scored.name),
            l AS (SELECT 'bought' AS type, 'dept:' || department AS a, 'item:' || name AS b, count(*)::DOUBLE AS w, count(*) AS c FROM items GROUP BY ALL
              UNION ALL SELECT 'supplies', 'item:' || name, 'contractor:' || contractor, sum(total_price), count(*) FROM items GROUP BY ALL
              UNION ALL SELECT 'contains', 'doc:' || source_file, 'item:' || name, count(*), count(*) FROM items GROUP BY ALL)
            SELECT 'node' AS kind, {_case("type", C.NODE_PREFIX)} || label AS id, NULL AS "from", NULL AS "to", label, type,
              CASE WHEN type = 'item' THEN {_case("level", C.RISK_COLOURS)} ELSE {_case("type", C.NODE_COLOURS)} END AS color,
              CASE WHEN type = 'item' THEN score END AS risk_score, CASE WHEN type = 'item' THEN level END AS risk_level, round(total, 2) AS total_price, NULL::DOUBLE AS weight, NULL::BIGINT AS item_count FROM v
            UNION ALL SELECT 'edge', NULL, a, b, {_case("type", C.EDGE_LABELS)}, type, NULL, NULL, NULL, NULL, round(w, 2), c FROM l""",
        "filtered_graph": f"""WITH {by_name}, n AS (
              SELECT 'item:' || name AS id, score AS risk_score, {_level("score")} AS risk_level, (SELECT round(sum(total_price), 2) FROM items i WHERE i.name = scored.name) AS total FROM scored WHERE score >= 80
              UNION ALL SELECT DISTINCT 'contractor:' || contractor, 0, 'LOW', 0 FROM items
            ) SELECT id, NULL AS target, risk_score, risk_level, total FROM n
            UNION ALL SELECT 'item:' || name, 'contractor:' || contractor, NULL, 'supplies', round(sum(total_price), 2) FROM items WHERE 'item:' || name IN (SELECT id FROM n) GROUP BY name, contractor""",
        "normalised_items": f"""WITH {NORMALISED} SELECT l_orderkey, l_linenumber, l_partkey, name, trim(regexp_replace(name, '10 шт', '')) AS canonical_name, unit, date, contractor,
              q AS quantity, u AS unit_price, t AS total_price, n_restored, mm AS mismatch, n_ambiguous, confidence FROM h""",
        "quality_report": f"""WITH {NORMALISED}, k AS (SELECT CAST(sum(n_restored) AS BIGINT) AS r, count(*) FILTER (mm) AS m, CAST(sum(n_ambiguous) AS BIGINT) AS a, count(*) AS total, avg(confidence) AS c, count(*) FILTER (confidence < 0.5) AS low FROM h)
            SELECT total, round(c, 3) AS avg_confidence, low AS low_confidence, r + m + a AS warnings_total, round(low / total * 100, 1) AS low_confidence_pct,
              '{{' || CASE WHEN a > 0 THEN '"ambiguous":' || CAST(a AS VARCHAR) || ',' ELSE '' END || '"mismatch":' || CAST(m AS VARCHAR) || ',"restored":' || CAST(r AS VARCHAR) || '}}' AS by_code FROM k""",
        "contractor_names": "SELECT s_suppkey, trim(regexp_replace(replace(lower(s_name), '#', ' '), '\\s+', ' ', 'g')) AS normalised FROM supplier",
        "name_overlaps": """WITH w AS (SELECT DISTINCT p_name AS name, list_distinct(string_split(p_name, ' ')) AS t FROM part)
            SELECT a.name AS x, b.name AS y, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard
            FROM w a JOIN w b ON a.name < b.name WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.3""",
        "last_verdicts": f"WITH {VERDICTS} SELECT item_name, arg_max(verdict, seq) AS verdict FROM log GROUP BY item_name",
        "flag_recommendations": f"""WITH {VERDICTS}, f AS (SELECT unnest(flags) AS flag, verdict FROM log), c AS (SELECT flag, count(*) FILTER (verdict = 'false_positive') AS fp_count, count(*) FILTER (verdict = 'confirmed_fraud') AS cf_count FROM f GROUP BY flag)
            SELECT flag, fp_count, cf_count, CASE WHEN fp_count >= 5 THEN 'suppress' WHEN cf_count >= 3 AND fp_count = 0 THEN 'amplify' ELSE 'keep' END AS recommendation FROM c WHERE fp_count + cf_count > 0""",
        "feedback_suppression": f"""WITH {by_name}, {VERDICTS}, v AS (SELECT item_name, arg_max(verdict, seq) AS verdict FROM log GROUP BY item_name),
            j AS (SELECT name, CASE WHEN verdict = 'false_positive' THEN least(score, 15) ELSE score END AS score, verdict AS user_verdict FROM scored LEFT JOIN v ON name = item_name)
            SELECT name, score, user_verdict, {_level("score")} AS risk_level FROM j""",
        **dict.fromkeys(("historical_prices", "stored_prices"), f"""WITH {ITEMS}, h AS (SELECT lower(trim(name)) AS item_name, unit_price FROM items), {_stats("item_name", "unit_price", "h")}
            SELECT item_name, n, median, round(mean, 4) AS mean, round(sd, 4) AS stdev, s[1] AS min, s[n] AS max FROM stats"""),
        "invalid_case_steps": """WITH e AS (SELECT event_id AS seq, user_id AS case_id, ['new', 'in_review', 'confirmed', 'false_positive', 'closed'][CAST(event_id % 5 AS INTEGER) + 1] AS now FROM events),
            l AS (SELECT *, lag(now) OVER (PARTITION BY case_id ORDER BY seq) AS before FROM e)
            SELECT before, now, count(*) AS n FROM l WHERE before IS NOT NULL AND NOT ((before = 'new' AND now IN ('in_review', 'closed')) OR (before = 'in_review' AND now IN ('confirmed', 'false_positive', 'closed', 'new'))
              OR (before IN ('confirmed', 'false_positive') AND now IN ('closed', 'in_review')) OR (before = 'closed' AND now = 'in_review')) GROUP BY ALL""",
        "event_windows": """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, round(sum(value), 4) AS sum_value FROM events GROUP BY ALL""",
        "event_sessions": """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events),
            s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
            SELECT user_id, min(ts) AS session_start, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM s GROUP BY user_id, k""",
    }
    out["finding_items"] = f"""WITH {ITEMS}, k AS (SELECT *, concat_ws('/', name, brand, unit) AS key FROM items),
        s AS (SELECT key AS name, CAST(t AS DOUBLE) AS threshold, date, ordinal FROM k JOIN (VALUES {split}) x(t) ON total_price >= t * (1 - {C.SPLIT_MARGIN}::DOUBLE) AND total_price < t),
        g AS (SELECT *, CASE WHEN date - lag(date) OVER w > {C.SPLIT_WINDOW_DAYS} THEN 1 ELSE 0 END AS new FROM s WHERE date IS NOT NULL WINDOW w AS (PARTITION BY name, threshold ORDER BY date, ordinal)),
        i AS (SELECT *, sum(new) OVER (PARTITION BY name, threshold ORDER BY date, ordinal) AS island FROM g),
        high AS (SELECT name, threshold, ordinal FROM i QUALIFY count(*) OVER (PARTITION BY name, threshold, island) >= 2),
        medium AS (SELECT name, threshold, ordinal FROM s QUALIFY count(*) OVER (PARTITION BY name, threshold) >= 2 AND count(date) OVER (PARTITION BY name, threshold) < 2),
        amounts AS (SELECT round(total_price, 2) AS amount FROM items WHERE total_price > 0 GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT name) >= 2),
        d AS (SELECT key, date, min(ordinal) AS f, max(ordinal) AS l FROM k GROUP BY ALL),
        p AS (SELECT *, lag(l) OVER w AS b, date - lag(date) OVER w AS gap FROM d WINDOW w AS (PARTITION BY key ORDER BY date)),
        h AS (SELECT DISTINCT key, unnest([b, f]) AS ordinal FROM p WHERE gap BETWEEN 1 AND 7),
        e AS (SELECT ordinal FROM items WHERE total_price >= 10000 AND total_price % 10000 = 0 QUALIFY count(*) OVER () >= 3)
        SELECT 'split_procurement' AS pattern, 'high' AS severity, name, threshold AS amount, CAST(ordinal AS VARCHAR) AS ordinal FROM high
        UNION ALL SELECT 'split_procurement', 'medium', name, threshold, CAST(ordinal AS VARCHAR) FROM medium
        UNION ALL SELECT 'repeated_amounts', 'medium', NULL, round(total_price, 2), CAST(ordinal AS VARCHAR) FROM items WHERE round(total_price, 2) IN (SELECT amount FROM amounts)
        UNION ALL SELECT 'suspicious_intervals', 'low', key, NULL, CAST(ordinal AS VARCHAR) FROM h
        UNION ALL SELECT 'round_number_cluster', 'low', NULL, NULL, CAST(ordinal AS VARCHAR) FROM e"""
    hasty = out["suspicious_intervals"].replace("name || brand AS name", "name")
    even = out["round_totals"].replace("floor(total_price / 1000) * 1000 AS v", "total_price AS v")
    whole = out["split_purchases"].replace("concat_ws('/', name, brand, department) AS name", "name").replace("CASE WHEN quantity > 46 THEN date END AS date", "date")
    n = {k: f"(SELECT count(*) FROM ({q}))" for k, q in (("split", whole), ("amounts", out["repeated_amounts"]), ("hasty", hasty), ("even", even))}
    out["pattern_summary"] = f"""SELECT high + medium + low AS pattern_count, CAST(0 AS BIGINT) AS critical, high, medium, low, false AS has_critical, high > 0 AS has_high
        FROM (SELECT {n["split"]} AS high, {n["amounts"]} AS medium, {n["hasty"]} + {n["even"]} AS low)"""
    words = "CASE right(p.p_brand, 1) WHEN '1' THEN 'ремонт' WHEN '2' THEN 'лицензия' WHEN '3' THEN 'аудит' WHEN '4' THEN 'бумага' ELSE 'прибор' END"
    kinds = "CASE right(brand, 1) WHEN '1' THEN 'строительство' WHEN '2' THEN 'ит' WHEN '3' THEN 'консалтинг' WHEN '4' THEN 'расходные материалы' ELSE 'default' END"
    factors = {label: w for label, _, w in C.CATEGORIES}
    factor = "CASE category " + " ".join(f"WHEN '{k}' THEN {factors[k]}::DOUBLE" for k in ("строительство", "ит", "консалтинг", "расходные материалы")) + " ELSE 1.0::DOUBLE END"
    base = "CASE f " + " ".join(f"WHEN '{f}' THEN {w}::DOUBLE" for f, w in C.FLAG_WEIGHTS.items()) + " ELSE 0 END"
    table = ITEMS.replace("p.p_name AS name", f"p.p_name || ' ' || {words} AS name")
    out["context_scores"] = f"""WITH {_scored("name, brand", table)}, k AS (SELECT *, {kinds} AS category FROM scored), m AS (SELECT *, {factor} * CASE WHEN department = 'BUILDING' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM k),
        c AS (SELECT *, CAST(least(100, coalesce(list_sum(list_transform(string_split(flags, ','), lambda f: least(100, round_even({base} * factor, 0)))), 0)) AS INTEGER) AS context_score FROM m)
        SELECT name, brand, category, score, context_score, {_level("context_score")} AS context_risk_level FROM c"""
    out["token_sort_scores"] = f"WITH {RATIO} SELECT x, y, round(score, 4) AS score FROM ratios WHERE score >= 40"
    out["resolved_contractors"] = f"""WITH {ITEMS}, s AS (
          SELECT contractor, CASE WHEN quantity > 25 THEN 'ООО «' || contractor || '»' ELSE upper(contractor) END AS raw, count(*) AS n FROM items GROUP BY ALL
        ), e AS (SELECT trim(replace(lower(contractor), '#', ' ')) AS normalised, arg_max(raw, len(raw)) AS canonical_name, count(*) AS alias_count, CAST(sum(n) AS BIGINT) AS mention_count FROM s GROUP BY contractor)
        SELECT canonical_name, normalised, CAST(NULL AS VARCHAR) AS inn, alias_count, mention_count, 'c:' || replace(left(normalised, 30), ' ', '_') || ':' || left(md5(normalised), 6) AS entity_id, 0.9 AS confidence FROM e"""
    out["running_prices"] = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS name, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, value AS price FROM events WHERE value > 0 AND user_id IS NOT NULL AND ts IS NOT NULL),
        b AS (SELECT *, lag(ts) OVER w AS bt, lag(price) OVER w AS bp FROM e WINDOW w AS (PARTITION BY name ORDER BY ts, seq)),
        s AS (SELECT *, sum(CASE WHEN ts - bt > INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER w AS span, CASE WHEN ts - bt <= INTERVAL 1 DAY THEN bp END AS previous FROM b WINDOW w AS (PARTITION BY name ORDER BY ts, seq))
        SELECT name, seq, count(*) OVER o AS n, CAST(round(sum(price) OVER o * 100) AS BIGINT) AS total_cents, previous FROM s WINDOW o AS (PARTITION BY name, span ORDER BY ts, seq)"""
    out["registered_contractors"] = out["resolved_contractors"]
    out["document_items"] = f"""WITH {ITEMS}, o AS (SELECT *, CAST(substr(source_file, 7) AS BIGINT) % 2 = 0 AS even, first_value(contractor) OVER (PARTITION BY source_file ORDER BY ordinal) AS c, min(date) OVER (PARTITION BY source_file) AS d FROM items)
        SELECT source_file, name, floor(quantity)::DOUBLE AS quantity, floor(unit_price) AS unit_price, floor(total_price) AS total_price, CASE WHEN even AND quantity % 2 = 1 THEN contractor ELSE c END AS contractor,
          CASE WHEN even THEN department ELSE '{C.UNKNOWN_DEPARTMENT}' END AS department, strftime(d, '%Y-%m-%d') AS date FROM o"""
    near = "round(0.5::DOUBLE * len(list_intersect(string_split(x, ' '), string_split(y, ' '))) / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))) + 0.5::DOUBLE * score / 100, 4)"
    out["name_clusters"] = f"""WITH RECURSIVE {ITEMS}, {RATIO}, e AS (SELECT x, y FROM ratios WHERE {near} >= {C.CLUSTER_THRESHOLD}), u AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
        f AS (SELECT name AS id, min(ordinal) AS o FROM items GROUP BY name), cc(id, comp) USING KEY (id) AS (
          SELECT id, o FROM f UNION SELECT u.b, min(cc.comp) FROM cc JOIN u ON cc.id = u.a JOIN recurring.cc AS old ON old.id = u.b WHERE cc.comp < old.comp GROUP BY u.b
        ) SELECT id AS name, id AS canonical_name, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster_id FROM cc"""
    return out
