"""The registered queries once more, as plain SQL over the same tables."""

from __future__ import annotations

O = """o AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS n, (c_acctbal + 1000) / 11000 AS x,
  dayofyear(o_orderdate) / 366.0::DOUBLE AS y, c_nationkey / 25.0::DOUBLE AS z, c_nationkey AS grp
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
Q = "q AS (SELECT * FROM o ORDER BY id LIMIT 10)"
P = "p0 AS (SELECT * FROM o ORDER BY id LIMIT 1), p1 AS (SELECT * FROM o ORDER BY id LIMIT 1 OFFSET 1)"
ROOT_IN, ROOT_OUT, INNER_IN, INNER_OUT = "0.9::DOUBLE", "(0.9::DOUBLE + 0.2::DOUBLE)", "0.7::DOUBLE", "(0.7::DOUBLE + 0.2::DOUBLE)"


def vec(a: str, b: str) -> str:
    return f"sqrt(({a}.x-{b}.x)*({a}.x-{b}.x) + ({a}.y-{b}.y)*({a}.y-{b}.y) + ({a}.z-{b}.z)*({a}.z-{b}.z))"


def dist(a: str, b: str) -> str:
    return f"(abs({a}.n-{b}.n) + {vec(a, b)})"


def every(radius: float) -> str:
    """Every object whose id 50 divides as a query, and a radius that falls with the rows."""
    return f"q AS (SELECT * FROM o WHERE id % 50 = 0), {shrunk(radius)}"


def shrunk(radius: float) -> str:
    return f"r AS (SELECT round({radius}::DOUBLE * 5.5::DOUBLE / sqrt(sqrt(count(*))), 6) AS r FROM o)"


R = "(SELECT r FROM r)"


def pairs(radius: float | str, columns: str = "q.id AS qid, o.id, round({d}, 6) AS dist", asked: str = Q) -> str:
    d = dist("o", "q")
    return f"WITH {O}, {asked} SELECT {columns.format(d=d)} FROM o CROSS JOIN q WHERE round({d}, 9) <= {radius}"


# Distances of map objects: over the names that both hold.
MAP_PAIRS = f"""SELECT q.id AS qid, o.id, round(abs(o.n - q.n)
  + CASE WHEN o.id % 3 <> 0 AND q.id % 3 <> 0 THEN {vec('o', 'q')} ELSE 0 END
  + CASE WHEN o.id % 2 = 0 AND q.id % 2 = 0 THEN abs(o.z - q.z) ELSE 0 END, 9) AS dist FROM o CROSS JOIN q"""

# Distances to the smallest id, with the two counts a balanced split weighs.
SPLIT = f"""WITH {O}, {P},
d AS (SELECT o.id, o.grp, {dist('o', 'p0')} AS d FROM o CROSS JOIN p0),
w AS (SELECT grp, d, count(*) OVER (PARTITION BY grp) AS n,
  count(*) OVER (PARTITION BY grp ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i,
  count(*) OVER (PARTITION BY grp ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 0.2::DOUBLE FOLLOWING) AS upto FROM d),
g AS (SELECT grp, max(n) AS n, max(least(i, n - upto)) AS best, min(CASE WHEN i > n // 2 THEN d END) AS med FROM w GROUP BY grp),
b AS (SELECT g.grp, CASE WHEN any_value(g.best) < any_value(g.n) // 4 THEN any_value(g.med)
  ELSE max(CASE WHEN least(w.i, w.n - w.upto) = g.best THEN w.d END) END AS lo, any_value(g.med) AS med
  FROM g JOIN w USING (grp) GROUP BY g.grp),
zz AS (SELECT d.id, d.grp, CASE WHEN d.d <= b.lo THEN 0 WHEN d.d > b.lo + 0.2::DOUBLE THEN 1 ELSE -1 END AS zone FROM d JOIN b USING (grp))
"""

# Addresses in the small hand-made index.
ADDRESS = f"""WITH {O}, {P},
pd AS (SELECT o.*, {dist('o', 'p0')} AS d0, {dist('o', 'p1')} AS d1 FROM o CROSS JOIN p0 CROSS JOIN p1),
a AS (SELECT *, CASE WHEN d0 > {ROOT_OUT} THEN 3 WHEN d0 <= {ROOT_IN} AND d1 <= {INNER_IN} THEN 4
  WHEN d0 <= {ROOT_IN} AND d1 > {INNER_OUT} THEN 5 END AS leaf FROM pd),
ad AS (SELECT *, CASE WHEN leaf IS NULL THEN 1 ELSE 0 END AS level, coalesce(leaf, 1) AS bucket FROM a)
"""


def reached(radius: float, all_queries: bool = False) -> str:
    """Buckets that balls of the queries reach, and how far outside each lies."""
    r = R if all_queries else f"{radius}::DOUBLE"
    chosen = "WHERE id % 50 = 0" if all_queries else "ORDER BY id LIMIT 10"
    return ADDRESS + (f", {shrunk(radius)}" if all_queries else "") + f""",
qq AS (SELECT id AS qid, n, x, y, z, d0, d1 FROM ad {chosen}),
t AS (SELECT qid, 0 AS level, 3 AS bucket, d0 + {r} > {ROOT_OUT} AS hit, d0 - {r} > {ROOT_OUT} AS inside,
    d0 > {ROOT_OUT} AS own, {ROOT_OUT} - d0 AS gap FROM qq
  UNION ALL SELECT qid, 0, 4, d0 - {r} <= {ROOT_IN} AND d1 - {r} <= {INNER_IN}, d0 + {r} <= {ROOT_IN} AND d1 + {r} <= {INNER_IN},
    d0 <= {ROOT_IN} AND d1 <= {INNER_IN}, greatest(d0 - {ROOT_IN}, d1 - {INNER_IN}) FROM qq
  UNION ALL SELECT qid, 0, 5, d0 - {r} <= {ROOT_IN} AND d1 + {r} > {INNER_OUT}, d0 + {r} <= {ROOT_IN} AND d1 - {r} > {INNER_OUT},
    d0 <= {ROOT_IN} AND d1 > {INNER_OUT}, greatest(d0 - {ROOT_IN}, {INNER_OUT} - d1) FROM qq
  UNION ALL SELECT qid, 1, 1, true, false, true, NULL FROM qq),
c AS (SELECT * FROM t WHERE hit AND (level = 0 OR qid NOT IN (SELECT qid FROM t WHERE inside)))
"""


def record(value: str) -> str:
    return f"CAST(CAST(floor({value} * 1000000.0::DOUBLE) / 1000000.0::DOUBLE AS DECIMAL(28,6)) AS VARCHAR)"


def label(value: str) -> str:
    return f"CAST(CAST(floor({value} * 10000.0::DOUBLE) / 10000.0::DOUBLE AS DECIMAL(18,4)) AS VARCHAR)"


def tenth(value: str) -> str:
    return f"floor({value} * 10) / 10"


def digit_group(i: int) -> str:
    return f"('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT / 4294967296.0::DOUBLE"


def many_sql() -> dict[str, str]:
    """The queries over every object whose id 50 divides."""
    indexed = pairs(R, asked=every(0.2))
    ranked = f"""WITH {O}, {every(0.2)}, a AS (SELECT q.id AS qid, o.id, {dist('o', 'q')} AS d FROM o CROSS JOIN q),
      s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM a"""
    return {
        "range_query_batch_many": pairs(0.2, asked="q AS (SELECT * FROM o WHERE id % 50 = 0)"),
        "range_query_indexed_many": indexed,
        "incremental_insert_answers_many": indexed,
        "stream_answers_many": indexed,
        "merge_answers_many": indexed,
        "range_query_limited_many": pairs(f"least({R}, 0.05::DOUBLE)", asked=every(0.2)),
        "pivot_exclude_many": pairs(R, "q.id AS qid, o.id", every(0.2)),
        "range_query_ids_many": pairs(R, "q.id AS qid, o.id", every(0.6)),
        "candidate_buckets_many": reached(0.05, True) + "SELECT qid, level, bucket FROM c",
        "range_query_approx_many": reached(0.2, True) + f""",
          s AS (SELECT qid, min(gap) FILTER (NOT own) AS certified FROM c GROUP BY qid)
          SELECT qq.qid, ad.id, round({dist('ad', 'qq')}, 6) AS dist FROM ad CROSS JOIN qq JOIN s USING (qid)
          WHERE round({dist('ad', 'qq')}, 9) <= {R} AND (certified IS NULL OR {dist('ad', 'qq')} < certified)""",
        "pivot_include_many": ADDRESS + f""", {shrunk(0.6)}, qq AS (SELECT * FROM ad WHERE id % 50 = 0)
          SELECT qq.id AS qid, ad.id FROM ad CROSS JOIN qq WHERE ad.d0 + qq.d0 <= {R} OR ad.d1 + qq.d1 <= {R}""",
        **dict.fromkeys(("knn_many", "knn_indexed_many"), ranked + ") SELECT qid, id, round(d, 6) AS dist, rank FROM s WHERE rank <= 5"),
        "knn_embeddings_many": """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
          q AS (SELECT * FROM e WHERE id % 50 = 0),
          a AS (SELECT q.id AS qid, e.id, list_distance(e.v, q.v) AS d FROM e CROSS JOIN q),
          r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM a)
          SELECT qid, id, round(d, 6) AS dist, rank FROM r WHERE rank <= 5""",
        "ranked_answers_many": ranked + f" WHERE round(d, 9) <= {R}) SELECT qid, rank, id FROM s",
        **{
            name: f"""WITH {O}, {every(radius)} SELECT q.id AS qid, count(o.id) AS n FROM q CROSS JOIN r LEFT JOIN o
              ON round({dist('o', 'q')}, 9) <= r.r GROUP BY q.id"""
            for name, radius in (("answer_counts_many", 0.05), ("answer_counts_indexed_many", 0.6))
        },
        "query_cost_many": reached(0.1, True) + f""", m AS (SELECT c.qid, c.level, c.bucket, ad.d0, ad.d1, qq.d0 AS e0, qq.d1 AS e1
            FROM c JOIN ad USING (level, bucket) JOIN qq USING (qid))
          SELECT c.qid, count(*) AS buckets, coalesce(any_value(k.candidates), 0) AS candidates, coalesce(any_value(k.after_filter), 0) AS after_filter
          FROM c LEFT JOIN (SELECT qid, count(*) AS candidates, count(*) FILTER (abs(d0 - e0) <= {R} AND abs(d1 - e1) <= {R})
            AS after_filter FROM m GROUP BY qid) k USING (qid) GROUP BY c.qid""",
    }


def oracle_sql() -> dict[str, str]:
    f1 = f"WITH {O} "
    plain = f1 + "SELECT id, n AS number FROM o"
    indexed = pairs(0.2)
    placed = f"WITH {O}, {P} SELECT o.id, o.n AS number, round({dist('o', 'p0')}, 6) AS pd0 FROM o CROSS JOIN p0"
    ranked = f"""WITH {O}, {Q}, a AS (SELECT q.id AS qid, o.id, {dist('o', 'q')} AS d FROM o CROSS JOIN q),
      r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM a"""
    names = "1 + CASE WHEN id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END"
    greedy = f"""WITH {O},
      s AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || id), id) - 1 AS rn FROM o QUALIFY rn < 512),
      g AS (SELECT c.rn AS c, a.rn AS pr, abs({dist('a', 'c')} - {dist('b', 'c')}) AS gap
        FROM s a JOIN s b ON b.rn = a.rn + 1 AND a.rn % 2 = 0 CROSS JOIN s c WHERE c.rn < 32),
      p0 AS (SELECT c FROM g GROUP BY c ORDER BY avg(gap) DESC, c LIMIT 1),
      g0 AS (SELECT pr, gap FROM g JOIN p0 USING (c)),
      p1 AS (SELECT g.c FROM g JOIN g0 USING (pr) WHERE g.c NOT IN (SELECT c FROM p0)
        GROUP BY g.c ORDER BY avg(greatest(g.gap, g0.gap)) DESC, g.c LIMIT 1),
      g1 AS (SELECT pr, greatest(g.gap, g0.gap) AS gap FROM g JOIN p1 USING (c) JOIN g0 USING (pr)),
      p2 AS (SELECT g.c FROM g JOIN g1 USING (pr) WHERE g.c NOT IN (SELECT c FROM p0 UNION ALL SELECT c FROM p1)
        GROUP BY g.c ORDER BY avg(greatest(g.gap, g1.gap)) DESC, g.c LIMIT 1)
      SELECT k.pivot_idx, s.id FROM (SELECT 0 AS pivot_idx, c FROM p0 UNION ALL SELECT 1, c FROM p1 UNION ALL SELECT 2, c FROM p2) k
      JOIN s ON s.rn = k.c"""
    return {
        "ingest_objects_text": f1 + "SELECT id, n AS number, x AS v0, y AS v1, z AS v2 FROM o",
        "ingest_text_keys": f1 + "SELECT 'order ' || id || '/' || grp AS id, n AS number, y AS v1 FROM o",
        "ingest_map_text": f1 + """SELECT id, n AS number, CASE WHEN id % 3 <> 0 THEN x END AS v0, CASE WHEN id % 3 <> 0 THEN y END AS v1,
          CASE WHEN id % 3 <> 0 THEN z END AS v2, CASE WHEN id % 2 = 0 THEN z END AS extra FROM o""",
        "rejected_records": f1 + """SELECT id, CASE WHEN id % 11 = 0 THEN 'key is not a number' WHEN id % 7 = 0 THEN 'bad number'
          ELSE 'bad vector' END AS error FROM o WHERE id % 11 = 0 OR id % 7 = 0 OR id % 5 = 0""",
        "export_objects_text": f1 + f"""SELECT id, id || chr(10) || 'number,vector' || chr(10) || {record('n')} || chr(10)
          || {record('x')} || ',' || {record('y')} || ',' || {record('z')} AS record FROM o""",
        "scan_objects": ADDRESS + "SELECT id, bucket FROM ad WHERE level = 0 AND bucket = 3",
        "append_objects": f1 + "SELECT grp, count(*) AS n FROM o GROUP BY grp",
        "delete_objects": f1 + "SELECT id FROM o WHERE id NOT IN (SELECT id FROM o ORDER BY id LIMIT 10)",
        "drop_bucket_range": f1 + "SELECT id, grp FROM o WHERE grp NOT BETWEEN 5 AND 9",
        "lookup_key": plain + " WHERE id = 7",
        "lookup_keys": plain + " WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
        "lookup_key_range": plain + " WHERE id BETWEEN 100 AND 4999",
        "generate_random_objects": "WITH h AS (SELECT o_orderkey AS id, md5('0:' || o_orderkey) AS h FROM orders) "
        f"SELECT id, {digit_group(0)} AS number, {digit_group(1)} AS v0, {digit_group(2)} AS v1, {digit_group(3)} AS v2 FROM h",
        "index_roundtrip": pairs(0.1),
        "index_delete": ADDRESS + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY n, x, y, z ORDER BY id) AS copy FROM ad)
          SELECT id, level, bucket FROM numbered WHERE NOT (copy = 1 AND (n, x, y, z) IN (SELECT (n, x, y, z) FROM ad ORDER BY id LIMIT 10))""",
        "index_drop_buckets": ADDRESS + "SELECT id, level, bucket FROM ad WHERE NOT (level = 0 AND bucket BETWEEN 4 AND 5)",
        "bucket_counts": f1 + "SELECT grp, count(*) AS n FROM o GROUP BY grp",
        "dist_number": f"WITH {O}, {Q} SELECT q.id AS qid, o.id, abs(o.n - q.n) AS d_number FROM o CROSS JOIN q",
        "dist_vector_l2": f"WITH {O}, {Q} SELECT q.id AS qid, o.id, round({vec('o', 'q')}, 6) AS d_vector FROM o CROSS JOIN q",
        "dist_vector_l2_embeddings": """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
          q AS (SELECT * FROM e ORDER BY id LIMIT 3)
          SELECT q.id AS qid, e.id, round(list_distance(e.v, q.v), 6) AS d_vector FROM e CROSS JOIN q""",
        "dist_composite_sum": f"""WITH {O}, {Q} SELECT q.id AS qid, o.id, abs(o.n - q.n) AS d_number,
          round({vec('o', 'q')}, 6) AS d_vector, round({dist('o', 'q')}, 6) AS dist FROM o CROSS JOIN q""",
        "dist_map_sum": f"WITH {O}, {Q} {MAP_PAIRS}",
        "range_query_batch_map": f"WITH {O}, {Q}, d AS ({MAP_PAIRS}) SELECT qid, id, dist FROM d WHERE dist <= 0.05",
        "knn_map": f"""WITH {O}, {Q}, d AS ({MAP_PAIRS}),
          r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d) SELECT qid, id, dist, rank FROM r WHERE rank <= 5""",
        "distance_report": f"WITH {O}, {P} SELECT o.id, round({dist('o', 'p0')}, 6) AS dist FROM o CROSS JOIN p0",
        "data_equal_groups": f1 + f"""SELECT number, CAST(CAST(x AS DECIMAL(9,1)) AS VARCHAR) || ',' || CAST(CAST(y AS DECIMAL(9,1)) AS VARCHAR)
          || ',' || CAST(CAST(z AS DECIMAL(9,1)) AS VARCHAR) AS vector, n FROM (SELECT {tenth('n')} AS number, {tenth('x')} AS x,
          {tenth('y')} AS y, {tenth('z')} AS z, count(*) AS n FROM o GROUP BY ALL HAVING count(*) > 1)""",
        "project_descriptor": f1 + f"""SELECT id, {names} AS n_names, id % 3 <> 0 AS has_vector, n AS number,
          1 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n_restricted FROM o""",
        "object_size_bytes": f1 + "SELECT id, 4 + 4 * 3 AS bytes FROM o",
        "object_size_bytes_embeddings": "SELECT vec_id AS id, 4 * len(embedding) AS bytes FROM embeddings",
        "object_label": f1 + f"SELECT id, id || ': ' || {label('n')} || ', [' || {label('x')} || ', ' || {label('y')} || ', ' || {label('z')} || ']' AS label FROM o",
        "zone_of": f"""WITH {O}, {P}, d AS (SELECT o.id, {dist('o', 'p0')} AS d FROM o CROSS JOIN p0)
          SELECT id, CASE WHEN d <= {ROOT_IN} THEN 0 WHEN d > {ROOT_OUT} THEN 1 ELSE -1 END AS zone FROM d""",
        "balanced_split": SPLIT + "SELECT grp, round(lo, 6) AS in_upper, round(lo + 0.2::DOUBLE, 6) AS out_lower FROM b",
        "median_split": SPLIT + "SELECT grp, round(med, 6) AS in_upper, round(med, 6) AS out_lower FROM b",
        "three_way_split": SPLIT + "SELECT id, zone FROM zz",
        "split_report": SPLIT + """SELECT grp, round(avg((zone = 0)::INT) * 100, 6) AS pct_in,
          round(avg((zone = -1)::INT) * 100, 6) AS pct_excl, round(avg((zone = 1)::INT) * 100, 6) AS pct_out FROM zz GROUP BY grp""",
        "choose_pivots": greedy,
        "pivot_distances": f"""WITH {O}, {P}, p AS (SELECT 0 AS pivot_idx, * FROM p0 UNION ALL SELECT 1, * FROM p1)
          SELECT o.id, p.pivot_idx, round({dist('o', 'p')}, 6) AS dist FROM o CROSS JOIN p""",
        "assign_address": ADDRESS + "SELECT id, level, bucket FROM ad",
        "overflowing_buckets": ADDRESS + "SELECT level, bucket, count(*) AS n FROM ad GROUP BY ALL HAVING count(*) > 100",
        "bulk_build": placed,
        "incremental_insert": placed,
        "index_report": ADDRESS + """, n AS (SELECT level, bucket, count(*) AS n FROM ad GROUP BY ALL),
          f(level, bucket, depth) AS (VALUES (0, 3, 1), (0, 4, 2), (0, 5, 2), (1, 1, 0)),
          j AS (SELECT f.*, coalesce(n.n, 0) AS n FROM f LEFT JOIN n USING (level, bucket))
          SELECT level, 0.1::DOUBLE AS rho, 100 AS capacity, CASE WHEN level = 0 THEN 2 ELSE 0 END AS pivots, count(*) AS buckets,
          sum(n)::BIGINT AS objects, round(avg(n) / 100, 6) AS occupation, max(depth) AS max_depth,
          string_agg(depth || ':' || bucket, ' ' ORDER BY depth, bucket) AS addresses,
          string_agg(n::VARCHAR, ' ' ORDER BY depth, bucket) AS counts FROM j GROUP BY level""",
        "stream_assign": placed,
        "range_query": f"""WITH {O}, {P} SELECT o.id, round({dist('o', 'p0')}, 6) AS dist FROM o CROSS JOIN p0
          WHERE round({dist('o', 'p0')}, 9) <= 0.2""",
        "range_query_batch": indexed,
        "candidate_buckets": reached(0.05) + "SELECT qid, level, bucket FROM c",
        "candidate_buckets_wide": reached(0.2) + "SELECT qid, level, bucket FROM c",
        "range_query_limited": pairs("0.05"),
        "range_query_approx": reached(0.2) + f""",
          s AS (SELECT qid, min(gap) FILTER (NOT own) AS certified FROM c GROUP BY qid)
          SELECT qq.qid, ad.id, round({dist('ad', 'qq')}, 6) AS dist FROM ad CROSS JOIN qq JOIN s USING (qid)
          WHERE round({dist('ad', 'qq')}, 9) <= 0.2 AND (certified IS NULL OR {dist('ad', 'qq')} < certified)""",
        "range_query_indexed": indexed,
        "incremental_insert_answers": indexed,
        "stream_answers": indexed,
        "range_query_indexed_partial": f"""WITH {O}, {Q}, d AS (SELECT q.id AS qid, o.id,
          CASE WHEN q.id % 2 = 0 THEN abs(o.n-q.n) ELSE 0 END + {vec('o', 'q')} AS d FROM o CROSS JOIN q)
          SELECT qid, id, round(d, 6) AS dist FROM d WHERE round(d, 9) <= 0.2""",
        "pivot_exclude_pairs": reached(0.2) + """SELECT c.qid, ad.id FROM c JOIN ad USING (level, bucket) JOIN qq USING (qid)
          WHERE abs(ad.d0 - qq.d0) <= 0.2 AND abs(ad.d1 - qq.d1) <= 0.2""",
        "pivot_exclude": pairs(0.2, "q.id AS qid, o.id"),
        "pivot_exclude_pushed": pairs(0.2, "q.id AS qid, o.id", Q.replace("LIMIT 10", "LIMIT 1")),
        "range_query_ids": pairs(0.6, "q.id AS qid, o.id"),
        "pivot_include": ADDRESS + """, qq AS (SELECT * FROM ad ORDER BY id LIMIT 10)
          SELECT qq.id AS qid, ad.id FROM ad CROSS JOIN qq WHERE ad.d0 + qq.d0 <= 0.6 OR ad.d1 + qq.d1 <= 0.6""",
        **dict.fromkeys(("knn", "knn_indexed"), ranked + ") SELECT qid, id, round(d, 6) AS dist, rank FROM r WHERE rank <= 5"),
        "knn_embeddings": """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
          q AS (SELECT * FROM e ORDER BY id LIMIT 3),
          a AS (SELECT q.id AS qid, e.id, list_distance(e.v, q.v) AS d FROM e CROSS JOIN q),
          r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM a)
          SELECT qid, id, round(d, 6) AS dist, rank FROM r WHERE rank <= 5""",
        "ranked_answers": ranked + " WHERE round(d, 9) <= 0.2) SELECT qid, rank, id FROM r",
        **{
            name: f"""WITH {O}, {Q} SELECT q.id AS qid, count(o.id) AS n FROM q LEFT JOIN o
              ON round({dist('o', 'q')}, 9) <= {radius} GROUP BY q.id"""
            for name, radius in (("answer_counts", 0.05), ("answer_counts_indexed", 0.6))
        },
        "query_cost": reached(0.1) + """, m AS (SELECT c.qid, c.level, c.bucket, ad.d0, ad.d1, qq.d0 AS e0, qq.d1 AS e1
            FROM c JOIN ad USING (level, bucket) JOIN qq USING (qid))
          SELECT c.qid, count(*) AS buckets, coalesce(any_value(k.candidates), 0) AS candidates, coalesce(any_value(k.after_filter), 0) AS after_filter
          FROM c LEFT JOIN (SELECT qid, count(*) AS candidates, count(*) FILTER (abs(d0 - e0) <= 0.1 AND abs(d1 - e1) <= 0.1)
            AS after_filter FROM m GROUP BY qid) k USING (qid) GROUP BY c.qid""",
        "query_cost_by_bucket": reached(0.1) + """, k AS (SELECT level, bucket, count(*) AS n FROM ad GROUP BY ALL)
          SELECT c.qid, c.level, c.bucket, coalesce(any_value(k.n), 0) AS candidates, count(*) FILTER (ad.id IS NOT NULL AND
            abs(ad.d0 - qq.d0) <= 0.1 AND abs(ad.d1 - qq.d1) <= 0.1) AS after_filter
          FROM c JOIN qq USING (qid) LEFT JOIN k USING (level, bucket) LEFT JOIN ad ON ad.level = c.level AND ad.bucket = c.bucket
          GROUP BY c.qid, c.level, c.bucket""",
        "merge_answers": indexed,
    } | many_sql()
