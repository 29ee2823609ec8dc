"""DuckDB statements that say independently what the queries of the catalogue return."""

NODES = """
kg_nodes AS (
  SELECT 'R' || r_regionkey AS node_id, CAST(r_regionkey AS BIGINT) AS seq, 'R' AS kind, r_name AS text, 'R' AS domain,
         CAST(0 AS DOUBLE) AS ts_sec, CAST(1 AS DOUBLE) AS acceleration_multiplier, CAST(1 + r_regionkey % 5 * 0.25 AS DOUBLE) AS zone_multiplier FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_nationkey + 1000000000, 'N', n_name, 'N', 0, 1, 1 + n_nationkey % 5 * 0.25 FROM nation
  UNION ALL SELECT 'S' || s_suppkey, s_suppkey + 2000000000, 'S', s_name, 'S', coalesce(f.ts, 0), 1, 1 + s_suppkey % 5 * 0.25
  FROM supplier LEFT JOIN (SELECT l_suppkey AS k, date_diff('second', TIMESTAMP '1970-01-01', min(l_shipdate)) AS ts FROM lineitem GROUP BY 1) f ON f.k = s_suppkey
  UNION ALL SELECT 'P' || p_partkey, p_partkey + 3000000000, 'P', p_name, p_type, coalesce(f.ts, 0), 1 + p_size / CAST(50 AS DOUBLE), 1 + p_partkey % 5 * 0.25
  FROM part LEFT JOIN (SELECT l_partkey AS k, date_diff('second', TIMESTAMP '1970-01-01', min(l_shipdate)) AS ts FROM lineitem GROUP BY 1) f ON f.k = p_partkey
)"""
SUPPLY = """
supply AS (
  SELECT l_suppkey AS suppkey, l_partkey AS partkey, count(*) AS n_obs, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_weight
  FROM lineitem GROUP BY 1, 2
), strong AS (SELECT suppkey AS s, partkey AS p, n_obs FROM supply WHERE n_obs >= 2)"""
EDGES = """
kg_edges AS (
  SELECT 'S' || suppkey AS src, 'P' || partkey AS tgt, FALSE AS is_containment, total_weight, n_obs FROM supply
  UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, TRUE, 1.0, 1 FROM nation
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, TRUE, 1.0, 1 FROM supplier
)"""
WEIGHTS = """
weights AS (
  SELECT n.node_id, n.seq, n.kind, n.text, CAST(w.weight AS BIGINT) AS weight FROM kg_nodes n JOIN (
    SELECT 'S' || suppkey AS node_id, sum(n_obs) AS weight FROM supply GROUP BY 1
    UNION ALL SELECT 'P' || partkey, sum(n_obs) FROM supply GROUP BY 1) w ON w.node_id = n.node_id
), scores AS (SELECT *, 100 * percent_rank() OVER (PARTITION BY kind ORDER BY weight) AS score FROM weights)"""
GAPS = """
pairs AS (SELECT a.s, b.s AS t, count(*) AS common FROM strong a JOIN strong b ON a.p = b.p AND a.s <> b.s GROUP BY 1, 2),
gaps AS (
  SELECT pairs.s, strong.p, CAST(sum(common) AS BIGINT) AS gap_score FROM pairs JOIN strong ON strong.s = pairs.t
  WHERE NOT EXISTS (SELECT 1 FROM strong x WHERE x.s = pairs.s AND x.p = strong.p) GROUP BY 1, 2
)"""
SERIES = """
series AS (SELECT user_id AS epoch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS loss FROM events)"""
MONTHS = "year({0}) * 12 + month({0}) - 1"

ORACLES = {
    "node_features": f"""
WITH {NODES} SELECT node_id, row_number() OVER (ORDER BY seq) - 1 AS pos,
  greatest(least(CASE WHEN ts_sec <> 0 THEN CAST(trunc(ts_sec / 31536000.0 + 1970) AS INTEGER) ELSE 2000 END, 2100), 1700) AS year_approx,
  acceleration_multiplier, zone_multiplier, substring(text, 1, 50) AS label FROM kg_nodes""",
    "edge_partition": f"""
WITH {NODES}, {SUPPLY}, {EDGES}, kept AS (SELECT n.* FROM kg_nodes n LEFT JOIN part ON n.node_id = 'P' || p_partkey WHERE kind <> 'P' OR p_size <= 25)
SELECT src, tgt, CASE WHEN is_containment THEN 'containment' ELSE 'regular' END AS part, CASE WHEN is_containment THEN a.zone_multiplier END AS multiplier, total_weight
FROM kg_edges JOIN kept a ON a.node_id = src JOIN kept b ON b.node_id = tgt""",
    "dangling_edges": f"""
WITH {NODES}, {SUPPLY}, {EDGES}, kept AS (SELECT n.* FROM kg_nodes n LEFT JOIN part ON n.node_id = 'P' || p_partkey WHERE kind <> 'P' OR p_size <= 25)
SELECT src, tgt FROM kg_edges WHERE src NOT IN (SELECT node_id FROM kept) OR tgt NOT IN (SELECT node_id FROM kept)""",
    "graph_size": f"""
WITH {NODES}, {SUPPLY}, {EDGES} SELECT (SELECT count(*) FROM kg_nodes) AS n_nodes, count(*) AS n_edges,
  count(*) FILTER (WHERE is_containment) AS n_containment, count(*) FILTER (WHERE NOT is_containment AND n_obs >= 2) AS n_strong FROM kg_edges""",
    "text_lookup": f"""
WITH {NODES}, needles(needle) AS (VALUES ('red widget'), ('RED'), ('supplier#00000000'), ('nation_7'), (''), ('zzz')),
met AS (SELECT needle, node_id, text, seq, CASE WHEN lower(text) = lower(needle) THEN 0 ELSE 1 END AS tier FROM kg_nodes, needles WHERE contains(lower(text), lower(needle)))
SELECT needle, node_id, text, tier FROM met QUALIFY row_number() OVER (PARTITION BY needle ORDER BY tier, seq) = 1""",
    "edge_between": f"""
WITH {SUPPLY}, wanted(a, b) AS (VALUES (0, 1), (0, 2), (1, 2), (3, 3), (2, 999999)),
c AS (SELECT w.a, w.b, (SELECT count(*) FROM strong x JOIN strong y ON x.p = y.p WHERE x.s = w.a AND y.s = w.b) AS common_parts,
  (SELECT count(*) FROM strong WHERE s = w.a) + (SELECT count(*) FROM strong WHERE s = w.b) AS both_parts FROM wanted w)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, common_parts, both_parts - common_parts AS union_parts, common_parts / CAST(nullif(both_parts - common_parts, 0) AS DOUBLE) AS probability FROM c""",
    "existing_edge": f"""
WITH {SUPPLY}, {EDGES}, ends AS (SELECT 'S' || min(suppkey) AS s, 'P' || min_by(partkey, suppkey * 1000000 + partkey) AS p FROM supply),
wanted AS (SELECT s AS a, p AS b FROM ends UNION ALL SELECT p, s FROM ends UNION ALL SELECT s, 'nowhere' FROM ends)
SELECT a, b, CASE WHEN f.src IS NOT NULL THEN 'forward' WHEN r.src IS NOT NULL THEN 'reverse' ELSE 'none' END AS direction, coalesce(f.total_weight, r.total_weight) AS total_weight
FROM wanted LEFT JOIN kg_edges f ON f.src = a AND f.tgt = b LEFT JOIN kg_edges r ON r.src = b AND r.tgt = a""",
    "top_nodes": f"""
WITH {NODES}, {SUPPLY}, {WEIGHTS} SELECT row_number() OVER (ORDER BY score DESC, seq) AS rank, node_id, substring(text, 1, 55) AS label, round(score, 6) AS score FROM scores ORDER BY score DESC, seq LIMIT 10""",
    "scan_alerts": f"""
WITH {NODES}, {SUPPLY}, {WEIGHTS} SELECT node_id, text AS node_text, weight, round(score, 6) AS score FROM scores WHERE score >= 72.5 ORDER BY score DESC, seq LIMIT 10""",
    "pressure_top5": f"""
WITH {NODES}, {SUPPLY}, both_ways AS (SELECT 'S' || s AS a, 'P' || p AS b, n_obs FROM strong UNION ALL SELECT 'P' || p, 'S' || s, n_obs FROM strong),
f AS (SELECT a, round(sum(n_obs * acceleration_multiplier), 4) AS pressure FROM both_ways JOIN kg_nodes ON node_id = b GROUP BY 1)
SELECT node_id, substring(text, 1, 30) AS label, pressure FROM f JOIN kg_nodes ON node_id = a ORDER BY pressure DESC, seq LIMIT 5""",
    "phantom_gaps": f"""WITH {SUPPLY}, {GAPS} SELECT s, p, gap_score FROM gaps ORDER BY gap_score DESC, s, p LIMIT 100""",
    "rupture_nodes": f"""
WITH {SUPPLY}, {GAPS}, t AS (SELECT 'S' || s AS node_id, 'S' AS kind, CAST(sum(gap_score) AS BIGINT) AS tension FROM gaps GROUP BY s
  UNION ALL SELECT 'P' || p, 'P', CAST(sum(gap_score) AS BIGINT) FROM gaps GROUP BY p)
SELECT node_id, kind, tension, tension > avg(tension) OVER (PARTITION BY kind) + 2 * stddev_pop(tension) OVER (PARTITION BY kind) AS ruptured FROM t""",
    "pre_breakthrough": f"""
WITH n AS (SELECT p_brand AS brand, {MONTHS.format('l_shipdate')} AS month, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
grid AS (SELECT b.brand, m.month FROM (SELECT DISTINCT brand FROM n) b, (SELECT unnest(range((SELECT min(month) FROM n), (SELECT max(month) FROM n) + 1)) AS month) m),
f AS (SELECT grid.brand, grid.month, coalesce(n.n, 0) AS n FROM grid LEFT JOIN n ON n.brand = grid.brand AND n.month = grid.month),
v AS (SELECT *, n - lag(n) OVER (PARTITION BY brand ORDER BY month) AS velocity FROM f),
a AS (SELECT *, velocity - lag(velocity) OVER (PARTITION BY brand ORDER BY month) AS acceleration FROM v)
SELECT brand, CAST(month AS INTEGER) AS month, n, velocity, acceleration, coalesce(velocity > 0 AND acceleration > 0, FALSE) AS candidate FROM a""",
    "convergence_score": """
WITH f AS (SELECT p_brand AS brand, CAST(year(l_shipdate) AS INTEGER) AS year, count(DISTINCT (l_suppkey, l_partkey)) AS density, count(*) AS n, count(DISTINCT l_suppkey) AS m, avg(1 - l_discount) AS mood
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
a AS (SELECT *, n - 2 * lag(n, 1) OVER w + lag(n, 2) OVER w AS acceleration FROM f WINDOW w AS (PARTITION BY brand ORDER BY year))
SELECT brand, year, density, acceleration, round(n * mood * m, 4) AS pressure, round(density * acceleration * n * mood * m / 144, 5) AS score FROM a""",
    "entropy_alert": """
WITH n AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2),
e AS (SELECT day, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 9) AS entropy FROM n GROUP BY 1),
b AS (SELECT strftime(day, '%Y-%m-%d') AS day, round(entropy, 6) AS entropy, round(avg(entropy) OVER (ORDER BY e.day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS before FROM e)
SELECT *, coalesce(entropy < before - 0.05, FALSE) AS alert FROM b""",
    "containment_tree": """
WITH RECURSIVE child AS (
  SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS node, count(*) OVER (PARTITION BY n_regionkey) AS k FROM nation
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, count(*) OVER (PARTITION BY s_nationkey) FROM supplier),
tree AS (SELECT '/R' || r_regionkey AS path, 'R' || r_regionkey AS node_id, 0 AS depth, CAST(1 AS DOUBLE) AS share FROM region
  UNION ALL SELECT path || '/' || node, node, depth + 1, share / k FROM tree JOIN child ON parent = node_id)
SELECT path, node_id, depth, round(share, 9) AS share FROM tree""",
    "recursive_forecast": f"""
WITH RECURSIVE {NODES}, {SUPPLY}, both_ways AS (SELECT 'S' || s AS a, 'P' || p AS b, n_obs FROM strong UNION ALL SELECT 'P' || p, 'S' || s, n_obs FROM strong),
links AS (SELECT a, b, seq, n_obs / CAST(max(n_obs) OVER (PARTITION BY a) AS DOUBLE) AS share FROM both_ways JOIN kg_nodes ON node_id = b),
start AS (SELECT DISTINCT a FROM links WHERE a = 'S0'),
d1 AS (SELECT b AS node_id, round(0.8 * max(share), 9) AS confidence, 1 AS depth FROM links JOIN start USING (a) WHERE b NOT IN (SELECT a FROM start) GROUP BY b, seq ORDER BY 2 DESC, seq LIMIT 5),
s1 AS (SELECT a AS node_id FROM start UNION ALL SELECT node_id FROM d1),
d2 AS (SELECT b AS node_id, max(round(confidence * 0.8 * share, 9)) AS confidence, 2 AS depth FROM links JOIN d1 ON d1.node_id = a WHERE b NOT IN (SELECT node_id FROM s1) GROUP BY b, seq ORDER BY 2 DESC, seq LIMIT 5),
s2 AS (SELECT node_id FROM s1 UNION ALL SELECT node_id FROM d2),
d3 AS (SELECT b AS node_id, max(round(confidence * 0.8 * share, 9)) AS confidence, 3 AS depth FROM links JOIN d2 ON d2.node_id = a WHERE b NOT IN (SELECT node_id FROM s2) GROUP BY b, seq ORDER BY 2 DESC, seq LIMIT 5),
s3 AS (SELECT node_id FROM s2 UNION ALL SELECT node_id FROM d3),
d4 AS (SELECT b AS node_id, max(round(confidence * 0.8 * share, 9)) AS confidence, 4 AS depth FROM links JOIN d3 ON d3.node_id = a WHERE b NOT IN (SELECT node_id FROM s3) GROUP BY b, seq ORDER BY 2 DESC, seq LIMIT 5)
SELECT depth, node_id, confidence FROM d1 UNION ALL SELECT depth, node_id, confidence FROM d2 UNION ALL SELECT depth, node_id, confidence FROM d3 UNION ALL SELECT depth, node_id, confidence FROM d4""",
    "equifinal_paths": f"""
WITH {SUPPLY}, e AS (SELECT s, p, n_obs / CAST(1 + n_obs AS DOUBLE) AS c FROM strong),
paths AS (SELECT p, c AS chance, -1 AS vp, -1 AS vs FROM e WHERE s = 0
  UNION ALL SELECT z.p, x.c * y.c * z.c, x.p, y.s FROM e x JOIN e y ON y.p = x.p AND y.s <> 0 JOIN e z ON z.s = y.s AND z.p <> x.p WHERE x.s = 0),
kept AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY p ORDER BY round(chance, 12) DESC, vp, vs) <= 20)
SELECT p, count(*) AS n_paths, round(1 - exp(sum(ln(1 - chance))), 6) AS probability FROM kept GROUP BY p""",
    "source_sink_role": f"""
WITH {SUPPLY}, {EDGES}, o AS (SELECT src AS k, count(*) AS n FROM kg_edges GROUP BY 1), i AS (SELECT tgt AS k, count(*) AS n FROM kg_edges GROUP BY 1)
SELECT coalesce(o.k, i.k) AS node_id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree,
  CASE WHEN coalesce(o.n, 0) > coalesce(i.n, 0) THEN 'source' WHEN coalesce(o.n, 0) < coalesce(i.n, 0) THEN 'sink' ELSE 'relay' END AS role FROM o FULL JOIN i ON o.k = i.k""",
    "cross_domain_bridges": f"""
WITH {SUPPLY}, e AS (SELECT s, p_type AS domain, count(*) AS k FROM strong JOIN part ON p_partkey = p GROUP BY 1, 2)
SELECT a.domain AS domain_a, b.domain AS domain_b, count(*) AS n_suppliers, CAST(sum(a.k * b.k) AS BIGINT) AS n_links FROM e a JOIN e b ON a.s = b.s AND a.domain < b.domain GROUP BY 1, 2""",
    "bottleneck_missing": f"""
WITH {SUPPLY}, have AS (SELECT DISTINCT s, p_brand || ' ' || p_type AS missing FROM strong JOIN part ON p_partkey = p),
gone AS (SELECT s, missing FROM (SELECT DISTINCT s FROM have), (SELECT DISTINCT p_brand || ' ' || p_type AS missing FROM part) EXCEPT SELECT s, missing FROM have)
SELECT s, missing, count(*) OVER (PARTITION BY missing) AS n_blocked FROM gone""",
    "cooccurrence": """
WITH t AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents) GROUP BY 1, 2),
f AS (SELECT token, count(*) AS df FROM t GROUP BY 1),
k AS (SELECT doc_id, token FROM t JOIN f USING (token)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln((SELECT CAST(count(*) AS DOUBLE) FROM documents) / df), 6) DESC, token) <= 32)
SELECT x.token AS a, y.token AS b, count(*) AS n FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.token < y.token GROUP BY 1, 2 HAVING count(*) >= 3""",
    "credibility_consolidate": """
WITH c AS (SELECT source, avg(CAST(quality AS DOUBLE)) AS cred FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, count(*) AS n_docs, round(sum(coalesce(cred, 1)), 4) AS mass, round(sum(coalesce(cred, 1) * n_chars) / nullif(sum(coalesce(cred, 1)), 0), 4) AS mean_chars FROM documents LEFT JOIN c USING (source) GROUP BY 1""",
    "canonical_ids": "SELECT doc_id, substring(md5(source), 1, 2) || substring(md5(lang), 1, 2) || substring(md5(text), 1, 20) AS canonical_id FROM documents",
    "orphan_clusters": """
SELECT label, count(*) AS n_vectors, count(g.doc_id) AS n_good, count(g.doc_id) = 0 AS orphan
FROM embeddings LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g ON g.doc_id = vec_id GROUP BY label""",
    "iceberg_ratio": """
SELECT source, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_informal, count(l.doc_id) AS n_formal,
  round(count(*) FILTER (WHERE l.doc_id IS NULL) / CAST(nullif(count(l.doc_id), 0) AS DOUBLE), 6) AS ratio
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""",
    "zone_density": """
WITH n AS (SELECT event_type, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT event_type, avg(n) AS mean FROM n GROUP BY 1)
SELECT event_type, hour, n, round(n / mean, 6) AS density, n >= 2.5 * mean AS dense FROM n JOIN m USING (event_type)""",
    "zone_events": """
WITH zones(zone_id, a, b, multiplier) AS (VALUES (1, TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-06', CAST(1.5 AS DOUBLE)), (2, TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-16', CAST(4 AS DOUBLE)))
SELECT zone_id, multiplier, count(*) AS n, round(sum(value), 4) AS total FROM events LEFT JOIN zones ON ts >= a AND ts < b GROUP BY 1, 2""",
    "dormant_reactivation": """
WITH g AS (SELECT event_id, user_id, CAST(trunc((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0) AS BIGINT) AS gap_seconds FROM events)
SELECT *, coalesce(gap_seconds >= 172800, FALSE) AS reactivated FROM g""",
    "velocity_doubling": f"""
WITH n AS (SELECT {MONTHS.format('o_orderdate')} AS month, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT m.month, coalesce(n.n, 0) AS n FROM (SELECT unnest(range((SELECT min(month) FROM n), (SELECT max(month) FROM n) + 1)) AS month) m LEFT JOIN n ON n.month = m.month),
r AS (SELECT CAST(month AS INTEGER) AS month, n, round(n / CAST(nullif(lag(n, 18) OVER (ORDER BY month), 0) AS DOUBLE), 6) AS ratio FROM f)
SELECT *, coalesce(ratio >= 2, FALSE) AS doubled FROM r""",
    "sync_acceleration": """
WITH n AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT t.event_type, d.day FROM (SELECT DISTINCT event_type FROM n) t, (SELECT CAST(unnest(generate_series((SELECT min(day) FROM n), (SELECT max(day) FROM n), INTERVAL 1 DAY)) AS DATE) AS day) d),
f AS (SELECT g.event_type, g.day, coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON n.event_type = g.event_type AND n.day = g.day)
SELECT a.event_type AS a, b.event_type AS b, round(corr(a.n, b.n), 6) AS correlation FROM f a JOIN f b ON a.day = b.day AND a.event_type < b.event_type GROUP BY 1, 2""",
    "investment_velocity": """
WITH y AS (SELECT c_mktsegment AS segment, year(o_orderdate) AS year, sum(o_totalprice) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
e AS (SELECT segment, arg_min(total, year) AS f, arg_max(total, year) AS l FROM y GROUP BY 1)
SELECT segment, round(f, 2) AS first_total, round(l, 2) AS last_total, round(l / f, 6) AS ratio FROM e""",
    "time_warp_split": """
SELECT o_custkey AS custkey, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01') AS n_before, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS n_after,
  n_before >= 5 AS predicted, n_after >= 3 AS happened FROM orders GROUP BY 1""",
    "retrospective_miss": """
WITH s AS (SELECT count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01') >= 5 AS p, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01') >= 3 AS h FROM orders GROUP BY o_custkey),
c AS (SELECT count(*) FILTER (WHERE p AND h) AS hits, count(*) FILTER (WHERE NOT p AND h) AS missed, count(*) FILTER (WHERE p AND NOT h) AS false_alarms FROM s)
SELECT *, round(hits / CAST(nullif(hits + false_alarms, 0) AS DOUBLE), 6) AS precision, round(hits / CAST(nullif(hits + missed, 0) AS DOUBLE), 6) AS recall FROM c""",
    "what_if": """
SELECT CAST(s AS INTEGER) AS scenario, count(*) AS n, round(avg(value), 6) AS mean_value FROM events, (SELECT unnest(range(100)) AS s) WHERE (event_id * 7919 + s * 104729) % 1000 < 500 GROUP BY 1""",
    "vector_search": """
WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_dot_product(q.v, x.v), 6) AS similarity FROM x, x q WHERE q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""",
    "hash_embedder_seed": "SELECT doc_id, CAST('0x' || right(md5(text), 8) AS BIGINT) AS seed FROM documents",
    "rolling_loss": f"WITH {SERIES} SELECT epoch, i, round(avg(loss) OVER (PARTITION BY epoch ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS mean_loss FROM series",
    "best_so_far": f"""
WITH {SERIES} SELECT epoch, i, loss, loss < coalesce(min(loss) OVER (PARTITION BY epoch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity') AS improved FROM series""",
    "ema_series": f"""
WITH RECURSIVE {SERIES}, f AS (SELECT epoch, i, loss AS e FROM series WHERE i = 0
  UNION ALL SELECT s.epoch, s.i, CAST(0.9 AS DOUBLE) * f.e + (1 - CAST(0.9 AS DOUBLE)) * s.loss FROM f JOIN series s ON s.epoch = f.epoch AND s.i = f.i + 1)
SELECT epoch, CAST(max(i) + 1 AS INTEGER) AS n, round(arg_max(e, i), 6) AS ema FROM f GROUP BY epoch""",
    "early_stopping": f"""
WITH RECURSIVE {SERIES}, f AS (SELECT epoch, i, loss AS best, 0 AS bad, -1 AS stop FROM series WHERE i = 0
  UNION ALL SELECT s.epoch, s.i, CASE WHEN s.loss < best - 0.00001 THEN s.loss ELSE best END, CASE WHEN s.loss < best - 0.00001 THEN 0 ELSE bad + 1 END,
    CASE WHEN s.loss < best - 0.00001 THEN -1 WHEN bad + 1 >= 10 THEN CAST(s.i AS INTEGER) ELSE -1 END
  FROM f JOIN series s ON s.epoch = f.epoch AND s.i = f.i + 1 WHERE f.stop < 0)
SELECT epoch, arg_max(stop, i) AS stopped_at, arg_max(best, i) AS best FROM f GROUP BY epoch""",
    "lr_schedule": """
SELECT e AS epoch, round(CASE WHEN e < 5 THEN 0.0001 * (0.001 + 0.999 * e / 5) ELSE 0.0000001 + (0.0001 - 0.0000001) * (1 + cos(pi() * (e - 5) / 95)) / 2 END, 12) AS lr FROM (SELECT unnest(range(100)) AS e)""",
    "batch_means": f"""
WITH {SERIES}, b AS (SELECT epoch, i // 16 AS batch, avg(loss) AS m, count(*) AS k FROM series GROUP BY 1, 2)
SELECT epoch, count(*) AS n_batches, CAST(ceil(count(*) / 2.0) AS BIGINT) AS n_steps, round(avg(m), 6) AS mean_of_means, round(avg(m) FILTER (WHERE k = 16), 6) AS train_loss FROM b GROUP BY epoch""",
    "checkpoint_retention": """
WITH f AS (SELECT o_orderkey AS id, o_orderstatus AS prefix, o_orderdate AS mtime FROM orders)
SELECT id, prefix FROM f QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY mtime DESC, id DESC) > 3""",
    "metric_map": """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS step, count(*) AS n, count(DISTINCT user_id) AS u, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)
SELECT step, 'ext' AS subsystem, 'n_events' AS metric, n AS value FROM d UNION ALL SELECT step, 'ext', 'n_users', u FROM d UNION ALL SELECT step, 'dyn', 'errors', e FROM d""",
    "inhibitory_drag": """
SELECT l_suppkey AS s, round(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity), 4) AS drive, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 4) AS drag,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) <= 0.5 * sum(l_quantity) AS feasible FROM lineitem GROUP BY 1""",
    "report": f"""
WITH {NODES}, {SUPPLY}, {WEIGHTS}, {GAPS}
SELECT * FROM (SELECT 'alert' AS section, row_number() OVER (ORDER BY score DESC, seq) AS rank, node_id AS item, round(score, 6) AS value FROM scores WHERE score >= 72.5 ORDER BY rank LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'phantom', row_number() OVER (ORDER BY gap_score DESC, s, p), 'S' || s || '>P' || p, CAST(gap_score AS DOUBLE) FROM gaps ORDER BY 2 LIMIT 10)
UNION ALL SELECT 'size', 1, 'nodes', CAST(count(*) AS DOUBLE) FROM kg_nodes""",
    "stream_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR""",
    "signals_union": """
SELECT origin, count(*) AS n, count(author) AS n_authors, count(strength) AS n_strengths FROM (
  SELECT 'event' AS origin, CAST(user_id AS VARCHAR) AS author, value AS strength FROM events UNION ALL SELECT 'document', source, NULL FROM documents UNION ALL SELECT 'page', NULL, NULL FROM pages) GROUP BY 1""",
    "isomorphism": f"""
WITH {SUPPLY}, deg AS (SELECT p, count(*) AS degree FROM strong GROUP BY 1), d AS (SELECT p_type AS domain, degree, count(*) AS n FROM deg JOIN part ON p_partkey = p GROUP BY 1, 2)
SELECT a.domain AS domain_a, b.domain AS domain_b, a.degree, a.n AS n_a, b.n AS n_b FROM d a JOIN d b ON a.degree = b.degree AND a.domain < b.domain""",
    "simultaneous_discovery": f"""
SELECT p_brand AS brand, min({MONTHS.format('l_shipdate')}) AS first_month, max({MONTHS.format('l_shipdate')}) AS last_month, count(DISTINCT l_suppkey) AS n_people FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "readiness": f"""
WITH {SUPPLY}, s AS (SELECT p_type AS domain, count(DISTINCT s) AS suppliers, sum(n_obs) AS obs, avg(p_size) AS size, avg(p_retailprice) AS price FROM strong JOIN part ON p_partkey = p GROUP BY 1)
SELECT domain, suppliers >= 5 AS structural, obs >= 1000 AS cultural, size <= 26 AS resource, price <= 1500 AS temporal, suppliers >= 5 AND obs >= 1000 AND size <= 26 AND price <= 1500 AS ready FROM s""",
    "node_vectors": f"""
WITH {NODES} SELECT node_id, CASE WHEN ts_sec <> 0 THEN round((CAST(trunc(ts_sec / 31536000.0 + 1970) AS INTEGER) - 1900) / CAST(100 AS DOUBLE), 6) ELSE 0 END AS a,
  CASE WHEN ts_sec <> 0 THEN round(acceleration_multiplier, 6) ELSE 0 END AS b, CASE WHEN ts_sec <> 0 THEN round(zone_multiplier, 6) ELSE 0 END AS c FROM kg_nodes""",
    "message_passing": f"""
WITH {NODES}, {SUPPLY}, both_ways AS (SELECT 'S' || s AS src, 'P' || p AS tgt FROM strong UNION ALL SELECT 'P' || p, 'S' || s FROM strong),
v0 AS (SELECT node_id, CASE WHEN ts_sec <> 0 THEN (CAST(trunc(ts_sec / 31536000.0 + 1970) AS INTEGER) - 1900) / CAST(100 AS DOUBLE) ELSE 0 END AS a,
  CASE WHEN ts_sec <> 0 THEN acceleration_multiplier ELSE 0 END AS b, CASE WHEN ts_sec <> 0 THEN zone_multiplier ELSE 0 END AS c FROM kg_nodes),
n1 AS (SELECT tgt, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM both_ways JOIN v0 ON node_id = src GROUP BY 1),
v1 AS (SELECT node_id, (v0.a + coalesce(n1.a, v0.a)) / 2 AS a, (v0.b + coalesce(n1.b, v0.b)) / 2 AS b, (v0.c + coalesce(n1.c, v0.c)) / 2 AS c FROM v0 LEFT JOIN n1 ON tgt = node_id),
n2 AS (SELECT tgt, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM both_ways JOIN v1 ON node_id = src GROUP BY 1)
SELECT node_id, round((v1.a + coalesce(n2.a, v1.a)) / 2 + 1e-10, 6) AS a, round((v1.b + coalesce(n2.b, v1.b)) / 2 + 1e-10, 6) AS b, round((v1.c + coalesce(n2.c, v1.c)) / 2 + 1e-10, 6) AS c FROM v1 LEFT JOIN n2 ON tgt = node_id""",
    "topology_features": f"""
WITH {NODES}, {SUPPLY}, t AS (SELECT 'S' || suppkey AS k, count(*) AS degree, CAST(sum(n_obs) AS BIGINT) AS strength, round(avg(total_weight), 4) AS mean_weight FROM supply GROUP BY 1
  UNION ALL SELECT 'P' || partkey, count(*), CAST(sum(n_obs) AS BIGINT), round(avg(total_weight), 4) FROM supply GROUP BY 1)
SELECT node_id, degree, strength, mean_weight FROM kg_nodes LEFT JOIN t ON k = node_id""",
    "epoch_progress": f"""
WITH {SERIES} SELECT epoch, i, round((i + 1) / CAST(count(*) OVER (PARTITION BY epoch) AS DOUBLE), 6) AS progress, round(loss / 2, 6) AS scaled,
  round(sqrt(sum(loss * loss) OVER (PARTITION BY epoch ORDER BY i)), 6) AS norm, (i + 1) % 2 = 0 OR lead(i) OVER (PARTITION BY epoch ORDER BY i) IS NULL AS closes FROM series""",
    "recombination": f"""
WITH {SUPPLY}, k AS (SELECT DISTINCT s, p_type AS kind FROM strong JOIN part ON p_partkey = p), n AS (SELECT s, count(*) AS n FROM k GROUP BY 1),
pairs AS (SELECT a.s, b.s AS t, count(*) AS common FROM strong a JOIN strong b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2),
both_kinds AS (SELECT a.s, b.s AS t, count(*) AS kept FROM k a JOIN k b ON a.kind = b.kind AND a.s < b.s GROUP BY 1, 2)
SELECT s, t, common, CAST(kept AS INTEGER) AS kept, CAST(x.n + y.n - 2 * kept AS INTEGER) AS dropped FROM pairs JOIN both_kinds USING (s, t) JOIN n x USING (s) JOIN n y ON y.s = t WHERE kept >= 2""",
    "emerging_clusters": f"""
WITH {SUPPLY}, z AS (SELECT s_nationkey AS nation, count(*) AS n_suppliers FROM supplier GROUP BY 1), pairs AS (SELECT DISTINCT a.s, b.s AS t FROM strong a JOIN strong b ON a.p = b.p AND a.s < b.s),
l AS (SELECT x.s_nationkey AS nation, count(*) AS n FROM pairs JOIN supplier x ON x.s_suppkey = s JOIN supplier y ON y.s_suppkey = t AND y.s_nationkey = x.s_nationkey GROUP BY 1)
SELECT nation, n_suppliers, coalesce(n, 0) AS n_links, round(2 * coalesce(n, 0) / CAST(nullif(n_suppliers * (n_suppliers - 1), 0) AS DOUBLE), 6) AS density,
  coalesce(round(2 * coalesce(n, 0) / CAST(nullif(n_suppliers * (n_suppliers - 1), 0) AS DOUBLE), 6) >= 0.25, FALSE) AS emerging FROM z LEFT JOIN l USING (nation)""",
    "void_pressure": f"""WITH {SUPPLY}, {GAPS} SELECT s, count(*) AS n_gaps, round(sum(1 - exp(-gap_score / CAST(10 AS DOUBLE))), 6) AS pressure FROM gaps GROUP BY 1""",
}

ORACLES["symbolic_step"] = f"""
SELECT 'ext' AS subsystem, 'entropy_alerts' AS metric, count(*) AS value FROM ({ORACLES["entropy_alert"]}) WHERE alert
UNION ALL SELECT 'dyn', 'pre_breakthrough_candidates', count(*) FROM ({ORACLES["pre_breakthrough"]}) WHERE candidate
UNION ALL SELECT 'dyn', 'total_virtual_nodes', count(*) FROM (WITH {SUPPLY}, {GAPS} SELECT * FROM gaps)
UNION ALL SELECT 'topo', 'rupture_count', count(*) FROM ({ORACLES["rupture_nodes"]}) WHERE ruptured"""

ORACLES["forecast_scenario"] = f"""
WITH f AS ({ORACLES["recursive_forecast"]}), b AS (SELECT depth, max(confidence) AS best FROM f GROUP BY 1)
SELECT round(exp(avg(ln(best))), 6) AS coherence_score, round(1 - exp(avg(ln(best))), 6) AS collapse_probability, CAST(count(*) AS INTEGER) AS depth,
  CAST(least(5, (SELECT count(*) FROM f)) AS INTEGER) AS n_shown FROM b"""
ORACLES["bottleneck_rank"] = f"""
SELECT row_number() OVER (ORDER BY n_blocked DESC, missing) AS rank, * FROM (SELECT missing, count(*) AS n_blocked FROM ({ORACLES["bottleneck_missing"]}) GROUP BY 1) ORDER BY n_blocked DESC, missing LIMIT 10"""

#: Deliveries of the live graph's first 24 months.
LIVE = f"""
live AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS tgt, l_suppkey % 5 * 0.25 + 1 AS zone, count(*) AS n_obs, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_weight
  FROM lineitem WHERE {MONTHS.format("l_shipdate")} < (SELECT min({MONTHS.format("l_shipdate")}) FROM lineitem) + 24 GROUP BY 1, 2, 3),
examples AS (SELECT src, tgt, CAST(CASE WHEN n_obs >= 2 THEN 1 ELSE 0 END AS DOUBLE) AS y, CASE WHEN total_weight > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END AS a,
  CASE WHEN total_weight > 0 THEN ln(1 + total_weight) ELSE 0 END AS b, CASE WHEN total_weight > 0 THEN CAST(zone AS DOUBLE) ELSE 0 END AS c FROM live)"""

ORACLES |= {
    "edge_text_match": f"""
WITH {NODES}, {SUPPLY}, {EDGES}, texts(src, tgt) AS (VALUES ('supplier#000000000', 'nation_3'), ('Widget', 'zzz'), ('zzz', 'qqq'), ('SUPPLIER#000000001', 'supplier#000000002'), ('nation_1', 'asia')),
m AS (SELECT t.src, t.tgt, node_id, row_number() OVER (PARTITION BY t.src, t.tgt ORDER BY seq) AS r FROM texts t, kg_nodes WHERE contains(lower(text), lower(t.src)) OR contains(lower(text), lower(t.tgt))),
e AS (SELECT x.src, x.tgt, x.node_id AS a, y.node_id AS b FROM m x JOIN m y ON x.src = y.src AND x.tgt = y.tgt AND x.r = 1 AND y.r = 2)
SELECT e.src, e.tgt, a, b, CASE WHEN f.src IS NOT NULL THEN 'forward' WHEN r.src IS NOT NULL THEN 'reverse' ELSE 'none' END AS direction, coalesce(f.total_weight, r.total_weight) AS total_weight
FROM e LEFT JOIN kg_edges f ON f.src = a AND f.tgt = b LEFT JOIN kg_edges r ON r.src = b AND r.tgt = a""",
    "edge_vectors": f"""
WITH {SUPPLY} SELECT 'S' || suppkey AS src, 'P' || partkey AS tgt, CASE WHEN total_weight > 0 THEN round(n_obs / CAST(10 AS DOUBLE), 6) ELSE 0 END AS a,
  CASE WHEN total_weight > 0 THEN round(ln(1 + total_weight), 6) ELSE 0 END AS b, CASE WHEN total_weight > 0 THEN CAST(1 + suppkey % 5 * 0.25 AS DOUBLE) ELSE 0 END AS c
FROM supply JOIN supplier ON s_suppkey = suppkey JOIN part ON p_partkey = partkey""",
    "forecast_scores": f"""
WITH v AS ({ORACLES["node_vectors"]}) SELECT node_id, round(1 / (1 + exp(1.5 - a - 0.5 * b - 0.25 * c)), 6) AS score FROM v""",
    "training_set": f"WITH {LIVE} SELECT src, tgt, y, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM examples",
    "training_losses": f"WITH {LIVE} SELECT 'all' AS part, count(*) AS n, round(ln(2), 6) AS loss, round(avg(0.5 - y), 6) AS g0, round(avg((0.5 - y) * a), 6) AS g1 FROM examples",
    "averaged_weights": """
WITH m AS (SELECT 'S' || l_suppkey AS name, avg(l_discount) FILTER (WHERE l_shipdate < TIMESTAMP '1998-01-01') AS p, avg(l_discount) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-01-01') AS q FROM lineitem GROUP BY 1)
SELECT name, round(0.9 * p + (1 - CAST(0.9 AS DOUBLE)) * q, 6) AS value FROM m WHERE p IS NOT NULL AND q IS NOT NULL""",
    "trainable_size": "SELECT p_brand AS module, CAST(sum(CASE WHEN p_retailprice >= 1200 THEN p_size ELSE 0 END) AS BIGINT) AS n_trainable, CAST(sum(p_size) AS BIGINT) AS n_all FROM part GROUP BY 1",
    "number_formats": """
WITH x AS (SELECT s_suppkey, s_suppkey / CAST(7 AS DOUBLE) AS x, s_suppkey * 86461 + 1700000000 AS t FROM supplier)
SELECT s_suppkey, printf('%.1f%%', x * 100) AS percent, printf('%.3f', x) AS three, printf('%.3e', x) AS scientific, printf('%04d', s_suppkey) AS padded, format('{:,}', s_suppkey * 12345) AS thousands,
  printf('%.2f', x) || ', ' || printf('%.2f', x * 2) AS joined, t AS epoch_seconds, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso FROM x""",
    "time_left": """
WITH e AS (SELECT user_id AS epoch, row_number() OVER w - 1 AS i, CAST(trunc((epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1000000.0) AS BIGINT) AS elapsed, count(*) OVER (PARTITION BY user_id) AS k
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT epoch, i, round(elapsed / ((i + 1) / CAST(k AS DOUBLE)) * (1 - (i + 1) / CAST(k AS DOUBLE)), 4) AS eta FROM e""",
    "total_loss": """
SELECT l_returnflag AS batch, round(avg(l_discount) + 0.5 * avg(l_tax) + 0.25 * avg(l_quantity / 50) + avg(l_linenumber / CAST(7 AS DOUBLE)), 6) AS total FROM lineitem GROUP BY 1""",
    "component_zip": """
SELECT s_suppkey AS s, 'balance' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier WHERE s_suppkey % 2 = 0""",
    "readiness_gate": f"WITH {NODES} SELECT CAST(l AS BIGINT) AS least, (SELECT count(*) FROM kg_nodes) >= l AS ready FROM (VALUES (20), (100000000)) v(l)",
    "checkpoint_choice": """
SELECT 'checkpoint_epoch_' || o_orderkey AS name, CAST(0 AS INTEGER) AS epoch, o_orderkey AS global_step FROM orders ORDER BY o_orderdate DESC, 'checkpoint_epoch_' || o_orderkey LIMIT 1""",
    "unit_vectors": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * 3 AS DOUBLE)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) + 1e-8 AS n FROM v)
SELECT vec_id, round(v[1] / n, 5) AS first, round(list_dot_product(v, v) / (n * n), 5) AS norm FROM n""",
    "first_candidates": f"SELECT brand, month, acceleration FROM ({ORACLES['pre_breakthrough']}) WHERE candidate ORDER BY brand, month LIMIT 7",
    "score_bars": f"""
WITH {NODES}, {SUPPLY}, {WEIGHTS}, t AS (SELECT row_number() OVER (ORDER BY weight DESC, seq) AS rank, node_id, weight FROM scores ORDER BY weight DESC, seq LIMIT 10)
SELECT rank, node_id, round(weight / CAST(max(weight) OVER () AS DOUBLE), 6) AS share, repeat('#', CAST(trunc(weight / CAST(max(weight) OVER () AS DOUBLE) * 20) AS INTEGER)) AS bar FROM t""",
    "anchored_deliveries": """
WITH f AS (SELECT l_suppkey AS s, l_partkey AS p, min(l_shipdate) AS first FROM lineitem GROUP BY 1, 2)
SELECT s, p, strftime(first, '%Y-%m-%d') AS first FROM f n WHERE EXISTS (SELECT 1 FROM f x WHERE x.s = n.s AND x.first < n.first)""",
    "registered_dimensions": """
SELECT doc_id, CASE WHEN source IS NOT NULL THEN dense_rank() OVER (ORDER BY source NULLS LAST) - 1 END AS source_id, CASE WHEN lang IS NOT NULL THEN dense_rank() OVER (ORDER BY lang NULLS LAST) - 1 END AS lang_id FROM documents""",
    "dormant_neighbours": """
WITH g AS (SELECT event_id, user_id, CAST(trunc((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0) AS BIGINT) AS gap_seconds,
  CAST(trunc((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id))) / 1000000.0) AS BIGINT) AS neighbour_gap FROM events)
SELECT *, coalesce(gap_seconds >= 172800 AND neighbour_gap <= 86400, FALSE) AS reactivated FROM g""",
    "discovery_gaps": """
WITH f AS (SELECT p_brand AS brand, l_suppkey AS s, min(l_shipdate) AS first FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
g AS (SELECT brand, s, first, CAST(trunc((epoch_us(first) - epoch_us(lag(first) OVER (PARTITION BY brand ORDER BY first, s))) / 1000000.0) AS BIGINT) AS gap_seconds FROM f)
SELECT brand, s, gap_seconds, coalesce(gap_seconds < lag(gap_seconds) OVER (PARTITION BY brand ORDER BY first, s), FALSE) AS shrinking FROM g""",
    "breakthrough_alerts": f"""
WITH c AS ({ORACLES["convergence_score"]}) SELECT brand, year, score, coalesce(score >= 1000, FALSE) AS alert, CASE WHEN score >= 1000 THEN year * 12 + 23 END AS from_month, CASE WHEN score >= 1000 THEN year * 12 + 35 END AS to_month FROM c""",
    "predictions": f"""
WITH r AS ({ORACLES["readiness"]}), n AS (SELECT *, CAST(structural AS INTEGER) + CAST(cultural AS INTEGER) + CAST(resource AS INTEGER) + CAST(temporal AS INTEGER) AS k FROM r),
w AS (SELECT *, CAST(trunc(36 - k / 4.0 * 18) AS INTEGER) AS opens FROM n)
SELECT domain, round(CAST(25 AS DOUBLE) * k, 2) AS probability, opens, opens + 18 AS closes,
  concat_ws(', ', CASE WHEN NOT structural THEN 'structural' END, CASE WHEN NOT cultural THEN 'cultural' END, CASE WHEN NOT resource THEN 'resource' END, CASE WHEN NOT temporal THEN 'temporal' END) AS prerequisites,
  concat_ws(', ', CASE WHEN structural THEN 'structural' END, CASE WHEN cultural THEN 'cultural' END, CASE WHEN resource THEN 'resource' END, CASE WHEN temporal THEN 'temporal' END) AS conditions FROM w""",
    "resource_readiness": """
WITH y AS (SELECT p_brand AS brand, year(l_shipdate) AS year, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
e AS (SELECT brand, arg_min(price, year) AS f, arg_max(price, year) AS l FROM y GROUP BY 1) SELECT brand, round(f, 4) AS first_price, round(l, 4) AS last_price, round(l / f, 6) AS ratio FROM e""",
    "communities": f"""
WITH {SUPPLY}, links AS (SELECT a.s, b.s AS t FROM strong a JOIN strong b ON a.p = b.p AND a.s <> b.s GROUP BY 1, 2 HAVING count(*) >= 4),
l0 AS (SELECT DISTINCT s, s AS label FROM links),
l1 AS (SELECT s, label FROM (SELECT links.s, label, count(*) AS k FROM links JOIN l0 ON l0.s = t GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY s ORDER BY k DESC, label) = 1),
l2 AS (SELECT s, label FROM (SELECT links.s, label, count(*) AS k FROM links JOIN l1 ON l1.s = t GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY s ORDER BY k DESC, label) = 1),
l3 AS (SELECT s, label FROM (SELECT links.s, label, count(*) AS k FROM links JOIN l2 ON l2.s = t GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY s ORDER BY k DESC, label) = 1),
n AS (SELECT label, count(*) AS n FROM l3 GROUP BY 1),
i AS (SELECT x.label, count(*) AS n_links FROM links JOIN l3 x ON x.s = links.s JOIN l3 y ON y.s = links.t WHERE links.s < links.t AND x.label = y.label GROUP BY 1)
SELECT n.label AS community, n, coalesce(n_links, 0) AS n_links, round(2 * coalesce(n_links, 0) / CAST(nullif(n * (n - 1), 0) AS DOUBLE), 6) AS density,
  coalesce(2 * coalesce(n_links, 0) / CAST(nullif(n * (n - 1), 0) AS DOUBLE) >= 0.25, FALSE) AS emerging FROM n LEFT JOIN i ON i.label = n.label""",
    "competitors": """
SELECT p_brand AS brand, count(DISTINCT l_suppkey) AS n_labs, count(*) AS n_mentions, round(avg(CASE WHEN l_discount > 0.05 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share_positive FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "stream_sliding": """
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start FROM events, (SELECT unnest(range(4)) AS k)) SELECT strftime(start, '%Y-%m-%d %H') AS start, count(*) AS n FROM w GROUP BY 1""",
    "stream_averages": ORACLES["ema_series"],
}
