"""The catalog's queries in plain SQL, written independently of the Spark operators.

Similarities come from self-joins on the cluster here, the readable form of what the
operators do on blocks.
"""

from __future__ import annotations

SEED = 1234
DIM = 256

# -- shared table expressions -------------------------------------------------------------

_ITEMS = """
raw AS (
  SELECT vec_id AS item_id, CAST(label AS INTEGER) AS cluster_id,
         CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings),
unit AS (
  SELECT item_id, cluster_id, e,
         CASE WHEN n = 0 THEN e ELSE list_transform(e, lambda x: x / n) END AS u
  FROM (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM raw))"""


def _means(name: str, source: str, vec: str, spherical: bool) -> str:
    """``name(cluster_id, c)``: mean vectors of ``source``."""
    scaled = "list_transform(m, lambda x: x / sqrt(list_dot_product(m, m)))" if spherical else "m"
    return f"""
{name} AS (
  SELECT cluster_id, {scaled} AS c FROM (
    SELECT cluster_id, list(x ORDER BY i) AS m FROM (
      SELECT cluster_id, i, avg(x) AS x FROM (
        SELECT cluster_id, unnest({vec}) AS x, unnest(range(1, len({vec}) + 1)) AS i FROM {source})
      GROUP BY cluster_id, i)
    GROUP BY cluster_id))"""


def _sig(x: str) -> str:
    """Rounded to 9 significant digits."""
    unit = f"pow(10.0, floor(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE round({x} / {unit}, 8) * {unit} END"


def _clean(x: str) -> str:
    """A cosine distance without rounding noise around 0."""
    return f"CASE WHEN abs({x}) < 1e-14 THEN 0.0::DOUBLE ELSE {x} END"


_CENT = _means("cent", "unit", "u", True)
_MEAN = _means("cent", "raw", "e", False)
_MEASURED = f"""{_ITEMS},{_CENT},
measured AS (
  SELECT item_id, cluster_id, u, {_clean("(1 - list_dot_product(u, c))")} AS dist
  FROM unit JOIN cent USING (cluster_id))"""


def _ranked(direction: str = "DESC") -> str:
    return f"""{_MEASURED},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id
                               ORDER BY {_sig("dist")} {direction}, item_id) AS pos
  FROM measured)"""


def _hash(seed: int, item: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {item}), 1, 15) AS BIGINT)"


def _ordered(which: str = "hard") -> str:
    rule = {
        "hard": "pos",
        "easy": "count(*) OVER (PARTITION BY cluster_id) + 1 - pos",
        "random": "row_number() OVER (PARTITION BY cluster_id ORDER BY "
        + _hash(SEED, "item_id")
        + ", item_id)",
    }[which]
    return f"""{_ranked()},
ordered AS (SELECT item_id, cluster_id, u, dist, pos, {rule} AS order_pos FROM ranked)"""


def _sims(which: str = "hard", source: str = "ordered", same: str = "a.cluster_id = b.cluster_id") -> str:
    return f"""{_ordered(which)},
sims AS (
  SELECT b.item_id, b.cluster_id, b.pos, b.order_pos, b.dist,
         greatest(coalesce(max(list_dot_product(a.u, b.u)), 0), 0) AS m
  FROM {source} b LEFT JOIN {source} a ON {same} AND a.order_pos < b.order_pos
  GROUP BY ALL)"""


_PARTS = f"""{_ordered()},
parts AS (
  SELECT *, CAST((order_pos * n_parts - 1) // n AS INTEGER) AS part FROM (
    SELECT *, (n + 19) // 20 AS n_parts FROM (
      SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM ordered)))"""

_LENGTH = """
cls AS (SELECT doc_id AS item_id, CAST(n_chars // 100 AS INTEGER) AS cluster_id FROM documents),
sizes AS (SELECT cluster_id, count(*) AS cluster_size FROM cls GROUP BY cluster_id)"""


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def _elements(source: str, key: str, vec: str) -> str:
    return f"""SELECT {key}, i, {_r("x")} AS value FROM (
  SELECT {key}, unnest({vec}) AS x, unnest(range(0, len({vec}))) AS i FROM {source})"""


def _assign(score: str, better: str, centroids: str = _MEAN) -> str:
    return f"""WITH {_ITEMS},{centroids},
found AS (
  SELECT item_id, cent.cluster_id, {score} AS score
  FROM unit, cent)
SELECT item_id, cluster_id, {_r("score")} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score {better}, cluster_id) AS rn
  FROM found) WHERE rn = 1"""


_COS = "list_dot_product(u, c) / sqrt(list_dot_product(u, u) * list_dot_product(c, c))"
_L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _round_of(source: str, name: str, vec: str, score: str, better: str, spherical: bool) -> str:
    """One assign-and-average step from ``source`` to ``name``."""
    return f"""
{name}_a AS (
  SELECT item_id, {vec}, cluster_id FROM (
    SELECT item_id, {vec}, {source}.cluster_id,
           row_number() OVER (PARTITION BY item_id ORDER BY {score} {better}, {source}.cluster_id) AS rn
    FROM unit0, {source}) WHERE rn = 1),{_means(f"{name}_m", f"{name}_a", vec, spherical)},
{name} AS (
  SELECT cluster_id, coalesce({name}_m.c, {source}.c) AS c
  FROM {source} LEFT JOIN {name}_m USING (cluster_id))"""


_UNIT0 = "unit0 AS (SELECT item_id, u, e FROM unit)"

_PAIR_STATS = f"""{_ITEMS},
pairs AS (
  SELECT a.item_id, a.cluster_id, list_dot_product(a.u, b.u) AS s
  FROM unit a JOIN unit b ON a.cluster_id = b.cluster_id AND a.item_id <> b.item_id)"""

_EPS = "(VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) AS t(eps)"


def _std(table: str, keys: str) -> str:
    """Spread of a full similarity matrix from its off-diagonal entries."""
    return f"""
  SELECT {keys}, n AS cluster_size,
         CASE WHEN n > 1 THEN sqrt((s2 - s1 * s1 / (n * n)) / (n * n - 1)) END AS sd
  FROM (SELECT {keys}, count(*) AS n FROM {table} GROUP BY {keys})
  LEFT JOIN (
    SELECT {", ".join("a." + k.strip() for k in keys.split(","))},
           sum(list_dot_product(a.u, b.u)) AS s1, sum(list_dot_product(a.u, b.u) ** 2) AS s2
    FROM {table} a JOIN {table} b
      ON {" AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))}
     AND a.item_id <> b.item_id
    GROUP BY ALL) USING ({keys})"""


_EXTREMES = f"""WITH {_PAIR_STATS}
SELECT item_id, cluster_id, {_r("CASE WHEN count(s) > 0 THEN greatest(max(s), 0) END")} AS max_sim,
       {_r("CASE WHEN count(s) > 0 THEN least(min(s), 0) END")} AS min_sim
FROM unit LEFT JOIN pairs USING (item_id, cluster_id) GROUP BY item_id, cluster_id"""

_STD = f"""WITH {_ITEMS}
SELECT cluster_id, cluster_size, {_r("sd")} AS std_pair_sim FROM ({_std("unit", "cluster_id")})"""

_MAX_EARLIER = f"""WITH {_sims()}
SELECT item_id, cluster_id, order_pos, {_r("m")} AS max_earlier_sim FROM sims"""

_FILES = """
files AS (
  SELECT row_number() OVER (ORDER BY name) - 1 AS file_no, name
  FROM (SELECT 'image_' || doc_id || '.jpg' AS name FROM labels))"""

_MANIFEST = """
manifest AS (
  SELECT page_id, p.url, p.name,
         CASE WHEN p.url IS NULL THEN 'invalid' WHEN e.name IS NOT NULL THEN 'skipped'
              ELSE 'fetch' END AS status
  FROM (SELECT page_id, CASE WHEN url LIKE 'https:%' THEN url END AS url,
               'image_' || page_id || '.jpg' AS name FROM pages) p
  LEFT JOIN (SELECT 'image_' || doc_id || '.jpg' AS name FROM labels) e ON p.name = e.name)"""


def _split(exact: bool = False) -> str:
    if not exact:
        return f"""
splits AS (
  SELECT doc_id, CASE WHEN {_hash(SEED, "doc_id")} % 1000000 < 800000 THEN 'train'
                      ELSE 'test' END AS split FROM documents)"""
    return f"""
splits AS (
  SELECT doc_id, CASE WHEN rn <= CAST(floor(0.8 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT doc_id, count(*) OVER () AS n,
               row_number() OVER (ORDER BY {_hash(SEED, "doc_id")}, doc_id) AS rn FROM documents))"""


_WORDS = """
words AS (
  SELECT doc_id, unnest(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0B]+')) AS w FROM documents),
counts AS (
  SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 256 AS i, count(*) AS n
  FROM words WHERE w <> '' GROUP BY ALL)"""

_BAGS = f"""{_WORDS},
bags AS (
  SELECT d.doc_id AS item_id, d.cluster_id, list(coalesce(n, 0)::DOUBLE ORDER BY b.i) AS e
  FROM (SELECT doc_id, lang AS cluster_id FROM documents) d
  CROSS JOIN (SELECT unnest(range(0, {DIM})) AS i) b
  LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.i = b.i
  GROUP BY ALL),
unit AS (
  SELECT item_id, cluster_id,
         CASE WHEN n = 0 THEN e ELSE list_transform(e, lambda x: x / n) END AS u
  FROM (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM bags))"""

_DOCS = f"""{_BAGS},{_CENT},
ordered AS (
  SELECT item_id, cluster_id, u,
         row_number() OVER (PARTITION BY cluster_id
           ORDER BY {_sig("dist")} DESC, item_id) AS order_pos
  FROM (SELECT *, {_clean("(1 - list_dot_product(u, c))")} AS dist FROM unit JOIN cent USING (cluster_id)))"""

_DOT = "list_dot_product(u, c)"


def _starts(k: int, source: str, spherical: bool) -> str:
    """``cent``: the different vectors with the lowest hash of an id."""
    scaled = "list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))" if spherical else "e"
    where = "WHERE list_dot_product(e, e) > 0" if spherical else ""
    return f"""
hashed AS (SELECT item_id, e, {_hash(SEED, "item_id")} AS h FROM {source} {where}),
firsts AS (
  SELECT e, min((h % 1000000000000, h, item_id)) AS o FROM hashed GROUP BY e ORDER BY o LIMIT {k}),
cent AS (
  SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS cluster_id, {scaled} AS c FROM firsts)"""


def _rounds(n: int, vec: str, score: str, better: str, spherical: bool) -> str:
    names = ["cent", *(f"r{i}" for i in range(1, n + 1))]
    steps = [_round_of(a, b, vec, score, better, spherical) for a, b in zip(names, names[1:])]
    return ",".join(steps)


def _placed(last: str, score: str, better: str) -> str:
    return f"""
placed AS (
  SELECT item_id, u, e, c, cluster_id, s FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s {better}, cluster_id) AS rn
    FROM (SELECT item_id, u, e, c, {last}.cluster_id, {score} AS s FROM unit0, {last}))
  WHERE rn = 1)"""


_L2_EC = _L2.format(a="e", b="c")
_PLAIN = f"""WITH {_ITEMS},{_MEAN},{_UNIT0},{_placed("cent", _L2_EC, "ASC")},
measured AS (
  SELECT item_id, cluster_id, {_clean("(1 - " + _COS + ")")} AS dist FROM placed)"""

_HOLES = f"""{_ITEMS},
holes AS (
  SELECT item_id, u, CASE WHEN item_id % 7 <> 0 THEN cluster_id END AS cluster_id,
         (item_id * 37 % 101) * 1e-13::DOUBLE AS dist
  FROM unit),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_sig("dist")} DESC, item_id) AS pos,
         count(*) OVER (PARTITION BY cluster_id) AS n
  FROM holes)"""
_SAME = "a.cluster_id IS NOT DISTINCT FROM b.cluster_id"
_HOLE_PAIRS = f"""{_HOLES},
pairs AS (
  SELECT a.item_id, list_dot_product(a.u, b.u) AS s
  FROM ranked a JOIN ranked b ON {_SAME} AND a.item_id <> b.item_id)"""

ORACLE: dict[str, str] = {
    # vectors
    "l2_normalize": f"WITH {_ITEMS} {_elements('unit', 'item_id', 'u')}",
    "pair_dot": f"""WITH {_ITEMS},{_MEAN}
SELECT item_id, {_r("list_dot_product(e, c)")} AS dot FROM unit JOIN cent USING (cluster_id)""",
    "cosine_to_centroid": f"""WITH {_ITEMS},{_MEAN}
SELECT item_id, {_r(_COS)} AS sim, {_r("1 - " + _COS)} AS dist FROM unit JOIN cent USING (cluster_id)""",
    "l2_to_centroid": f"""WITH {_ITEMS},{_MEAN}
SELECT item_id, {_r(_L2.format(a="e", b="c"))} AS dist FROM unit JOIN cent USING (cluster_id)""",
    "l2_to_centroid_joined": f"""WITH {_ITEMS},{_MEAN}
SELECT item_id, {_r(_L2.format(a="e", b="c"))} AS dist FROM unit JOIN cent USING (cluster_id)""",
    "valid_vectors": """SELECT 'usable' AS kind, count(*) AS n FROM embeddings WHERE len(embedding) = 64
UNION ALL SELECT 'rejected', count(*) FROM embeddings
WHERE embedding IS NULL OR len(embedding) <> 64
   OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0""",
    # clustering
    "assign_cosine": _assign(_COS, "DESC"),
    "assign_ip": _assign("list_dot_product(e, c)", "DESC"),
    "assign_l2": _assign(_L2.format(a="e", b="c"), "ASC"),
    "assign_in_blocks": _assign(_COS, "DESC"),
    "dist_from_score": f"""WITH found AS ({_assign(_COS, "DESC", _CENT).replace(_r("score"), "score")})
SELECT item_id, cluster_id, {_r("1 - score")} AS dist FROM found""",
    "lloyd_2_rounds": f"""WITH {_ITEMS},{_CENT},{_UNIT0},
{_round_of("cent", "r1", "u", "list_dot_product(u, c)", "DESC", True)},
{_round_of("r1", "r2", "u", "list_dot_product(u, c)", "DESC", True)}
{_elements("r2", "cluster_id", "c")}""",
    "lloyd_l2_1_round": f"""WITH {_ITEMS},{_MEAN},{_UNIT0},
{_round_of("cent", "r1", "e", _L2.format(a="e", b="c"), "ASC", False)}
{_elements("r1", "cluster_id", "c")}""",
    "kmeans_cosine": f"""WITH {_ITEMS},{_starts(16, "raw", True)},{_UNIT0},
{_rounds(3, "u", _DOT, "DESC", True)},{_placed("r3", _DOT, "DESC")}
SELECT item_id, cluster_id, {_r("1 - s")} AS dist FROM placed""",
    "kmeans_l2": f"""WITH {_ITEMS},{_starts(16, "raw", False)},{_UNIT0},
{_rounds(3, "e", _L2_EC, "ASC", False)},{_placed("r3", _L2_EC, "ASC")}
SELECT item_id, cluster_id, {_r("s")} AS score FROM placed""",
    "dist_cosine_plain_kmeans": f"{_PLAIN} SELECT item_id, cluster_id, {_r('dist')} AS dist FROM measured",
    "rank_cosine_plain_kmeans": f"""{_PLAIN}
SELECT item_id, cluster_id,
       row_number() OVER (PARTITION BY cluster_id ORDER BY {_sig("dist")} DESC, item_id) AS pos
FROM measured""",
    # order
    "rank_hot_null_clusters": f"""WITH {_HOLES}
SELECT item_id, cluster_id, pos, n + 1 - pos AS order_pos,
       CAST(((n + 1 - pos) * ((n + 19) // 20) - 1) // n AS INTEGER) AS part FROM ranked""",
    "rank_hard": f"WITH {_ranked()} SELECT item_id, cluster_id, pos FROM ranked",
    "rank_nearest": f"WITH {_ranked('ASC')} SELECT item_id, cluster_id, pos FROM ranked",
    "rank_hot_cluster": f"WITH {_ranked()} SELECT item_id, cluster_id, pos FROM ranked",
    "order_easy": f"WITH {_ordered('easy')} SELECT item_id, cluster_id, pos, order_pos FROM ordered",
    "order_random": f"WITH {_ordered('random')} SELECT item_id, cluster_id, pos, order_pos FROM ordered",
    "split_clusters": f"WITH {_PARTS} SELECT item_id, cluster_id, order_pos, part FROM parts",
    # pruning
    "max_earlier_sim": _MAX_EARLIER,
    "max_earlier_sim_blocks": _MAX_EARLIER,
    "max_earlier_product": f"""WITH {_ordered()},
sims AS (
  SELECT b.item_id, b.cluster_id, b.order_pos,
         greatest(coalesce(max(list_dot_product(ra.e, rb.e)), 0), 0) AS m
  FROM ordered b JOIN raw rb ON rb.item_id = b.item_id
  LEFT JOIN (ordered a JOIN raw ra ON ra.item_id = a.item_id)
    ON a.cluster_id = b.cluster_id AND a.order_pos < b.order_pos
  GROUP BY ALL)
SELECT item_id, cluster_id, order_pos, {_r("m")} AS max_earlier_sim FROM sims""",
    "max_earlier_sim_in_parts": f"""WITH {_PARTS},
sims AS (
  SELECT b.item_id, b.cluster_id, b.order_pos,
         greatest(coalesce(max(list_dot_product(a.u, b.u)), 0), 0) AS m
  FROM parts b LEFT JOIN parts a
    ON a.cluster_id = b.cluster_id AND a.part = b.part AND a.order_pos < b.order_pos
  GROUP BY ALL)
SELECT item_id, cluster_id, order_pos, {_r("m")} AS max_earlier_sim FROM sims""",
    "max_earlier_sim_null_clusters": f"""WITH {_HOLES}
SELECT b.item_id, b.cluster_id, b.pos AS order_pos,
       {_r("greatest(coalesce(max(list_dot_product(a.u, b.u)), 0), 0)")} AS max_earlier_sim
FROM ranked b LEFT JOIN ranked a ON {_SAME} AND a.pos < b.pos
GROUP BY b.item_id, b.cluster_id, b.pos""",
    "flags_in_blocks": f"""WITH {_sims()}
SELECT item_id, cluster_id, m > 1 - 0.5::DOUBLE AS eps_0_5, m > 1 - 0.6::DOUBLE AS eps_0_6,
       m > 1 - 0.7::DOUBLE AS eps_0_7 FROM sims""",
    "rejects_given_clusters": f"""WITH {_sims().replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 50 NOT IN (0, 1, 2, 3))")}
SELECT item_id, 'kept' AS outcome FROM sims WHERE m <= 1 - 0.6::DOUBLE
UNION ALL SELECT vec_id, CASE vec_id % 50 WHEN 0 THEN 'null' WHEN 1 THEN 'dimension'
  WHEN 2 THEN 'not finite' ELSE 'no cluster' END FROM embeddings WHERE vec_id % 50 IN (0, 1, 2, 3)""",
    "flags_eps_list": f"""WITH {_sims()}
SELECT item_id, cluster_id, m > 1 - 0.5::DOUBLE AS eps_0_5, m > 1 - 0.6::DOUBLE AS eps_0_6,
       m > 1 - 0.7::DOUBLE AS eps_0_7 FROM sims""",
    "kept_items": f"WITH {_sims()} SELECT item_id, cluster_id FROM sims WHERE m <= 1 - 0.7::DOUBLE",
    "removed_items": f"WITH {_sims()} SELECT item_id, cluster_id FROM sims WHERE m > 1 - 0.7::DOUBLE",
    "dedup_given_clusters_easy": f"""WITH {_sims("easy")}
SELECT item_id, cluster_id, pos, order_pos FROM sims WHERE m <= 1 - 0.6::DOUBLE""",
    "resume_skip": f"""WITH {_sims()}
SELECT item_id, cluster_id, order_pos, m > 1 - 0.7::DOUBLE AS eps_0_7 FROM sims""",
    # sizes
    "cluster_sizes": f"WITH {_LENGTH} SELECT * FROM sizes",
    "size_summary": f"""WITH {_LENGTH}
SELECT count(*) AS n_clusters, max(cluster_size) AS max_size, min(cluster_size) AS min_size,
       {_r("avg(cluster_size)")} AS mean_size, count(*) FILTER (cluster_size = 1) AS n_singletons
FROM sizes""",
    "size_summary_with_empty": f"""WITH {_LENGTH},
dense AS (
  SELECT coalesce(cluster_size, 0) AS cluster_size
  FROM (SELECT unnest(range(0, (SELECT max(cluster_id) + 1 FROM sizes))) AS cluster_id)
  LEFT JOIN sizes USING (cluster_id))
SELECT count(*) AS n_clusters, max(cluster_size) AS max_size, min(cluster_size) AS min_size,
       {_r("avg(cluster_size)")} AS mean_size, count(*) FILTER (cluster_size = 1) AS n_singletons
FROM dense""",
    "size_histogram": f"""WITH {_LENGTH}
SELECT CAST(b AS INTEGER) AS size_bin, count(cluster_size) AS n_clusters
FROM (SELECT unnest(range(1, 12)) AS b) LEFT JOIN sizes ON least(cluster_size, 11) = b GROUP BY b""",
    "rank_clusters": f"""WITH {_LENGTH}
SELECT cluster_id, n AS cluster_size, row_number() OVER (ORDER BY n DESC, first) - 1 AS size_rank
FROM (SELECT cluster_id, count(*) AS n, min(item_id) AS first FROM cls GROUP BY cluster_id)""",
    "cluster_report_clusters": f"""WITH {_LENGTH}
SELECT cluster_id, n AS cluster_size, row_number() OVER (ORDER BY n DESC, first) - 1 AS size_rank
FROM (SELECT cluster_id, count(*) AS n, min(item_id) AS first FROM cls GROUP BY cluster_id)""",
    "ranked_members": f"""WITH {_LENGTH}
SELECT item_id, cluster_id, size_rank FROM cls JOIN (
  SELECT cluster_id, row_number() OVER (ORDER BY n DESC, first) - 1 AS size_rank
  FROM (SELECT cluster_id, count(*) AS n, min(item_id) AS first FROM cls GROUP BY cluster_id))
USING (cluster_id)""",
    "cluster_members": f"""WITH {_LENGTH}
SELECT item_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY item_id) AS member_no
FROM cls""",
    "top_clusters": f"""WITH {_LENGTH}
SELECT cluster_id, count(*) AS cluster_size FROM cls GROUP BY cluster_id
ORDER BY count(*) DESC, min(item_id) LIMIT 5""",
    "one_cluster": f"WITH {_LENGTH} SELECT * FROM cls WHERE cluster_id = 3",
    "cluster_range": f"WITH {_LENGTH} SELECT * FROM cls WHERE cluster_id >= 2 AND cluster_id < 10",
    "unique_keys": """SELECT lang, md5(text) AS key, count(*) AS copies FROM documents
GROUP BY ALL HAVING count(*) > 1""",
    # statistics
    "avg_sim_to_others": f"""WITH {_PAIR_STATS}
SELECT item_id, cluster_id, {_r("avg(s)")} AS avg_sim
FROM unit LEFT JOIN pairs USING (item_id, cluster_id) GROUP BY item_id, cluster_id""",
    "extreme_sims": _EXTREMES,
    "extreme_sims_blocks": _EXTREMES,
    "extreme_sims_null_clusters": f"""WITH {_HOLE_PAIRS}
SELECT item_id, cluster_id, {_r("CASE WHEN count(s) > 0 THEN greatest(max(s), 0) END")} AS max_sim,
       {_r("CASE WHEN count(s) > 0 THEN least(min(s), 0) END")} AS min_sim
FROM ranked LEFT JOIN pairs USING (item_id) GROUP BY item_id, cluster_id""",
    "avg_sim_null_clusters": f"""WITH {_HOLE_PAIRS}
SELECT item_id, cluster_id, {_r("avg(s)")} AS avg_sim
FROM ranked LEFT JOIN pairs USING (item_id) GROUP BY item_id, cluster_id""",
    "pairwise_std": _STD,
    "pairwise_std_chunks": _STD,
    "centroid_cohesion": f"""WITH {_MEASURED}
SELECT cluster_id, {_r("avg(1 - dist)")} AS avg_sim, {_r("stddev_pop(1 - dist)")} AS std_sim
FROM measured GROUP BY cluster_id""",
    "duplicate_report": f"""WITH {_sims()}
SELECT eps, cluster_id, count(*) AS cluster_size, count(*) FILTER (m > 1 - eps) AS num_duplicates,
       {_r("100.0::DOUBLE * count(*) FILTER (m > 1 - eps) / count(*)")} AS duplicates_ratio
FROM sims, {_EPS} GROUP BY eps, cluster_id""",
    "eps_sweep": f"""WITH {_sims()}
SELECT eps, {_r("avg(CASE WHEN m > 1 - eps THEN 0.0::DOUBLE ELSE 1 END)")} AS kept_fraction
FROM sims, {_EPS} GROUP BY eps""",
    "kept_count": f"""WITH {_sims()}
SELECT count(*) FILTER (m <= 1 - 0.7::DOUBLE) AS n_kept, count(*) FILTER (m > 1 - 0.7::DOUBLE) AS n_removed
FROM sims""",
    "prune_report_items": f"""WITH {_sims()},
pairs AS (
  SELECT a.item_id, list_dot_product(a.u, b.u) AS s
  FROM unit a JOIN unit b ON a.cluster_id = b.cluster_id AND a.item_id <> b.item_id),
others AS (
  SELECT item_id, avg(s) AS mean, greatest(max(s), 0) AS high, least(min(s), 0) AS low
  FROM pairs GROUP BY item_id)
SELECT item_id, cluster_id, m > 1 - 0.7::DOUBLE AS eps_0_7, {_r("mean")} AS avg_sim,
       {_r("high")} AS max_sim, {_r("low")} AS min_sim
FROM sims LEFT JOIN others USING (item_id)""",
    "eps_for_kept": f"""WITH {_sims()},
in_order AS (SELECT list_sort(list(m)) AS l, count(*) AS n FROM sims),
wanted AS (SELECT unnest([0.0, 0.1, 0.5, 0.9, 0.999]::DOUBLE[]) AS fraction),
chosen AS (
  SELECT fraction, CASE WHEN fraction = 0 THEN 0 ELSE l[CAST(ceil(fraction * n - 1e-9) AS BIGINT)] END AS s
  FROM wanted, in_order)
SELECT fraction, CASE WHEN s < 1 - 1e-12 THEN {_r("least(1.0::DOUBLE, 1 - s)")} END AS eps FROM chosen""",
    "raw_matrix": f"""WITH {_ITEMS},
numbered AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_id, e FROM raw)
SELECT item_id, i - 1 AS i, {_r("x")} AS value FROM (
  SELECT item_id, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM numbered)""",
    "raw_keys": """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS item_id, lang || '/' || doc_id || '-é' AS path
FROM documents WHERE lang IS NOT NULL""",
    "prune_report_clusters_in_parts": f"""WITH {_PARTS},
spread AS ({_std("parts", "cluster_id, part")}),
per_cluster AS (
  SELECT cluster_id, CAST(sum(cluster_size) AS BIGINT) AS cluster_size, avg(sd) AS sd
  FROM spread GROUP BY cluster_id)
SELECT cluster_id, cluster_size, {_r("any_value(sd)")} AS std_pair_sim,
       {_r("avg(1 - dist)")} AS avg_sim, {_r("stddev_pop(1 - dist)")} AS std_sim
FROM per_cluster JOIN measured USING (cluster_id) GROUP BY cluster_id, cluster_size""",
    # samples and splits
    "sample_per_cluster": f"""WITH {_LENGTH}
SELECT item_id, cluster_id FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_hash(SEED, "item_id")}, item_id) AS rn
  FROM cls) WHERE rn <= 3""",
    "preview": f"""WITH {_LENGTH},
top AS (
  SELECT cluster_id, count(*) AS cluster_size FROM cls GROUP BY cluster_id
  ORDER BY count(*) DESC, min(item_id) LIMIT 5),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_hash(SEED, "item_id")}, item_id) AS rn
  FROM cls JOIN top USING (cluster_id))
SELECT item_id, cluster_id, cluster_size, 0.5::DOUBLE AS dist, quality, toxic,
       l.doc_id IS NULL AS is_placeholder
FROM picked LEFT JOIN labels l ON l.doc_id = item_id WHERE rn <= 9""",
    "train_test_split": f"WITH {_split()} SELECT doc_id, split FROM splits",
    "train_test_split_exact": f"WITH {_split(exact=True)} SELECT doc_id, split FROM splits",
    "head_subset": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100",
    "accuracy": f"""WITH {_split()}
SELECT 'full' AS run, doc_id % 10 AS epoch, split AS phase, count(*) AS n,
       {_r("avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END)")} AS accuracy
FROM labels JOIN splits USING (doc_id) GROUP BY ALL""",
    # keys, names, files
    "output_names": """SELECT doc_id, 'image_' || doc_id || '.jpg' AS plain,
  'image_' || doc_id || '_class' || quality || '.jpg' AS labelled,
  'img-' || doc_id || '.png' AS patterned FROM labels""",
    "label_from_name": """SELECT doc_id, 'image_' || doc_id || '_class' || quality || '.jpg' AS name,
  CAST(CASE WHEN contains('_class' || quality || '.', 'class1') THEN 1 ELSE 0 END AS INTEGER) AS label
FROM labels""",
    "normalize_ext": """SELECT page_id, CASE
  WHEN ext IN ('jpg', 'jpeg', 'png', 'bmp', 'gif', 'webp') THEN ext ELSE 'jpg' END AS ext
FROM (SELECT page_id, lower(CASE WHEN contains(url, '.org/') THEN 'PNG'
                                 ELSE list_last(string_split(url, '.')) END) AS ext FROM pages)""",
    "truncate_keys": """SELECT page_id, substr(url, 1, 24) AS stored, substr(url, 1, 32) AS exported,
  list_last(string_split(url, '/')) AS base FROM pages""",
    "decode_keys": "SELECT page_id, url AS key FROM pages",
    "number_files": f"WITH {_FILES} SELECT file_no, name FROM files",
    "list_files": """SELECT unnest(range(0, count(*))) AS file_no
FROM (SELECT DISTINCT quality, toxic FROM labels)""",
    "resolve_files": f"""WITH {_FILES},
ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents
        UNION ALL SELECT 'image_' || doc_id FROM documents),
named AS (
  SELECT id, CASE WHEN regexp_full_match(id, '[0-9]+')
                  THEN coalesce(f.name, 'image_' || id || '.jpg') ELSE id || '.jpg' END AS source_file
  FROM ids LEFT JOIN files f ON CAST(f.file_no AS VARCHAR) = id)
SELECT id, source_file, g.name AS target_file,
       CASE WHEN g.name IS NULL THEN 'missing' ELSE 'found' END AS status
FROM named LEFT JOIN files g ON g.name = source_file""",
    "keep_documents": """SELECT doc_id, lang, n_chars, 'image_' || doc_id || '.jpg' AS image_path
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "missing_ids": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "attach_embeddings": f"""WITH {_ranked()}
SELECT item_id, cluster_id, pos, {_r("list_dot_product(e, e)")} AS norm2
FROM ranked JOIN raw USING (item_id, cluster_id)""",
    "attach_keys": f"""WITH {_sims()}
SELECT item_id, cluster_id, 'image_' || item_id || '_class' || cluster_id || '.jpg' AS path,
       m > 1 - 0.7::DOUBLE AS eps_0_7 FROM sims""",
    "fetch_manifest": f"WITH {_MANIFEST} SELECT page_id, url, name, status FROM manifest",
    "manifest_counts": f"WITH {_MANIFEST} SELECT status, count(*) AS n FROM manifest GROUP BY status",
    # written and read back
    "read_embeddings": """SELECT vec_id AS item_id, CAST(len(embedding) AS INTEGER) AS dim
FROM embeddings""",
    "written_sorted_clusters": f"""WITH {_MEASURED}
SELECT item_id, 'image_' || item_id || '.jpg' AS path, cluster_id, {_r("dist")} AS dist FROM measured""",
    "written_id_list": f"WITH {_sims()} SELECT item_id FROM sims WHERE m <= 1 - 0.7::DOUBLE",
    "written_dataset": f"""SELECT page_id, url, md5(html) AS payload FROM pages
WHERE {_hash(SEED, "page_id")} % 1000000 < 800000""",
    "written_clusters": _assign(_COS, "DESC", _CENT),
    "reused_assignments": _assign(_COS, "DESC", _CENT),
    "written_ranked_members": f"""WITH {_LENGTH}
SELECT item_id, cluster_id, size_rank FROM cls JOIN (
  SELECT cluster_id, row_number() OVER (ORDER BY n DESC, first) - 1 AS size_rank
  FROM (SELECT cluster_id, count(*) AS n, min(item_id) AS first FROM cls GROUP BY cluster_id))
USING (cluster_id)""",
    "written_size_list": f"WITH {_LENGTH} SELECT * FROM sizes",
    "written_stats": f"""WITH {_sims()}
SELECT eps, cluster_id, count(*) AS cluster_size, count(*) FILTER (m > 1 - eps) AS num_duplicates,
       {_r("100.0::DOUBLE * count(*) FILTER (m > 1 - eps) / count(*)")} AS duplicates_ratio
FROM sims, {_EPS} GROUP BY eps, cluster_id""",
    "written_cluster_stats": f"""WITH {_MEASURED}
SELECT cluster_id, count(*) AS cluster_size, {_r("avg(1 - dist)")} AS avg_sim,
       {_r("stddev_pop(1 - dist)")} AS std_sim FROM measured GROUP BY cluster_id""",
    "resolved_columns": "SELECT page_id AS item_id, url AS image FROM pages",
    # encoding and whole jobs
    "hash_encode": f"""WITH {_WORDS}
SELECT doc_id, i, {_r("n / sqrt(sum(n * n) OVER (PARTITION BY doc_id))")} AS value FROM counts""",
    "embed_documents": f"""WITH raw AS (
  SELECT doc_id, [length(text)::DOUBLE, (length(text) - length(replace(text, ' ', '')))::DOUBLE, 1.0::DOUBLE] AS e
  FROM documents),
unit AS (
  SELECT doc_id, list_transform(e, lambda x: CAST(x / sqrt(list_dot_product(e, e)) AS FLOAT)::DOUBLE) AS u FROM raw)
{_elements("unit", "doc_id", "u")}""",
    "dedup_from_given_centroids": f"""WITH {_ITEMS},{_CENT},{_UNIT0},
{_round_of("cent", "r1", "u", "list_dot_product(u, c)", "DESC", True)},
{_round_of("r1", "r2", "u", "list_dot_product(u, c)", "DESC", True)},
placed AS (
  SELECT item_id, u, cluster_id, {_clean("(1 - s)")} AS dist FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, cluster_id) AS rn
    FROM (SELECT item_id, u, r2.cluster_id, list_dot_product(u, c) AS s FROM unit0, r2))
  WHERE rn = 1),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_sig("dist")} DESC, item_id) AS order_pos
  FROM placed)
SELECT item_id, cluster_id FROM ordered b WHERE NOT EXISTS (
  SELECT 1 FROM ordered a
  WHERE a.cluster_id = b.cluster_id AND a.order_pos < b.order_pos
    AND list_dot_product(a.u, b.u) > 1 - 0.7::DOUBLE)""",
    "dedup_full": f"""WITH {_BAGS},{_starts(8, "bags", True)},
unit0 AS (SELECT item_id, u, e FROM unit JOIN bags USING (item_id)),
{_rounds(2, "u", _DOT, "DESC", True)},{_placed("r2", _DOT, "DESC")},
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_sig("dist")} DESC, item_id) AS order_pos
  FROM (SELECT *, {_clean("(1 - s)")} AS dist FROM placed)),
removed AS (
  SELECT DISTINCT b.item_id FROM ordered a JOIN ordered b
    ON a.cluster_id = b.cluster_id AND a.order_pos < b.order_pos
  WHERE list_dot_product(a.u, b.u) > 1 - 0.05::DOUBLE)
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT item_id FROM removed)""",
    "dedup_documents_by_lang": f"""WITH {_DOCS},
removed AS (
  SELECT DISTINCT b.item_id FROM ordered a JOIN ordered b
    ON a.cluster_id = b.cluster_id AND a.order_pos < b.order_pos
  WHERE list_dot_product(a.u, b.u) > 1 - 0.05::DOUBLE)
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT item_id FROM removed)""",
}
ORACLE["written_item_stats"] = ORACLE["prune_report_items"]
ORACLE["report_resumed"] = ORACLE["prune_report_items"]
ORACLE["written_summary"] = ORACLE["size_summary_with_empty"]
ORACLE["written_histogram"] = ORACLE["size_histogram"]
