"""DuckDB SQL for the queries of catalog.py, each one SELECT, built from shared CTEs.

Distances are float32 sums from left to right from 0 on, like the plans'.
"""

from __future__ import annotations

import struct

# A good object of two vectors (M 2, ksub 2, dsub 1), then: one more byte, one less, a wrong
# magic and version, a short header, nothing, no vectors, sizes that would wrap in 64 bits.
_GOOD = struct.pack("<7I4f", 0x43505100, 1, 2, 2, 2, 1, 2, 0.0, 1.0, 2.0, 3.0) + bytes([0, 1, 1, 0])
BLOB_CASES: list[str | None] = [x if x is None else x.hex() for x in (
    _GOOD, _GOOD + b"\0", _GOOD[:-1], b"\1" + _GOOD[1:], _GOOD[:4] + b"\2" + _GOOD[5:], _GOOD[:27], b"", None,
    struct.pack("<7I4f", 0x43505100, 1, 2, 2, 2, 1, 0, 0.0, 1.0, 2.0, 3.0), struct.pack("<7I", 0x43505100, 1, 0x80000000, 0x80000000, 1, 4, 1),
    struct.pack("<7I", 0x43505100, 1, 0, 0, 0, 0, 0), struct.pack("<7I", 0x43505100, 1, 1, 1, 1, 1, 255) + bytes(258))]
CONFIG_CASES: list[str | None] = [None, "{}", '{"max_cache_slots": 2, "hw_lib_path": "/x/y.so"}', '{"max_cache_slots": 0}', '{"max_cache_slots": -5}', '{"max_cache_slots": "abc"}', "not json", '{"hw_lib_path": "lib.so"}', '{"max_cache_slots": 128}', '{"max_cache_slots": "7"}']


def _quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _cases(name: str, values: list[str | None]) -> str:
    rows = ", ".join(f"({k}, {_quoted(v)})" for k, v in enumerate(values))
    return f"cases AS (SELECT case_id::INT AS case_id, {name}::VARCHAR AS {name} FROM (VALUES {rows}) AS t(case_id, {name}))"


def _sum(terms: str) -> str:
    return f"list_reduce(list_prepend(0::FLOAT, {terms}), lambda p, q: p + q)"


def l2(a: str, b: str) -> str:
    return _sum(f"list_transform(range(1, len({a}) + 1), lambda j: ({a}[j] - {b}[j]) * ({a}[j] - {b}[j]))")


def ip(a: str, b: str) -> str:
    return "(-" + _sum(f"list_transform(range(1, len({a}) + 1), lambda j: {a}[j] * {b}[j])") + ")"


DISTANCE = {"l2": l2, "ip": ip}

BASE = """queries AS (SELECT vec_id AS qid, embedding AS qvec FROM embeddings WHERE vec_id % 50 = 0),
centroids AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cluster_id, embedding AS centroid FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 4)),
words AS (SELECT m::INT AS m, (row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1)::INT AS k, embedding[8 * m + 1:8 * m + 8] AS c
  FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 16), range(8) t(m)),"""
ASSIGNED = f"""assigned AS (SELECT vec_id, arg_min(cluster_id, (d, cluster_id)) AS cluster_id
  FROM (SELECT vec_id, cluster_id, {l2("embedding", "centroid")} AS d FROM embeddings, centroids) GROUP BY vec_id),"""
CODED = f"""coded AS (SELECT vec_id, list(k ORDER BY m) AS codes FROM (
  SELECT vec_id, m, arg_min(k, (d, k)) AS k FROM (SELECT vec_id, m, k, {l2("embedding[8 * m + 1:8 * m + 8]", "c")} AS d FROM embeddings, words) GROUP BY vec_id, m) GROUP BY vec_id),
lists AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) - 1 AS vector_id, vec_id AS global_id, codes FROM assigned JOIN coded USING (vec_id)),"""
INDEX = BASE + ASSIGNED + CODED


def probes(metric: str, n: int = 2) -> str:
    return f"""probes AS (SELECT qid, qvec, rank, cluster_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, cluster_id) AS rank
  FROM (SELECT qid, qvec, cluster_id, {DISTANCE[metric]("qvec", "centroid")} AS distance FROM queries, centroids)) WHERE rank <= {n}),"""


def luts(metric: str, queries: str = "queries") -> str:
    return f"""lut AS (SELECT qid, m, k, {DISTANCE[metric]("qvec[8 * m + 1:8 * m + 8]", "c")} AS d FROM {queries}, words),
tables AS (SELECT qid, list(row ORDER BY m) AS t FROM (SELECT qid, m, list(d ORDER BY k) AS row FROM lut GROUP BY qid, m) GROUP BY qid),"""


ADC = _sum("list_transform(range(1, 9), lambda m: t[m][codes[m] + 1])")


def scanned(metric: str, nprobe: int = 2) -> str:
    return probes(metric, nprobe) + luts(metric) + f"scanned AS (SELECT p.qid, l.cluster_id, vector_id, global_id, {ADC} AS distance FROM probes p JOIN tables USING (qid) JOIN lists l ON l.cluster_id = p.cluster_id),"


def per_cluster(k: int = 10) -> str:
    return f"per_cluster AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, cluster_id ORDER BY distance, vector_id) AS rank FROM scanned) WHERE rank <= {k}),"


def gathered(k: int = 10, source: str = "scanned") -> str:
    return f"SELECT qid, rank, cluster_id, vector_id, global_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, cluster_id, vector_id) AS rank FROM {source}) WHERE rank <= {k}"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.rstrip().rstrip(',')} {select}"


REQUESTS = """requests AS (SELECT qid AS req, CASE WHEN n % 7 = 3 THEN qvec[1:63] WHEN n % 7 = 5 THEN list_append(qvec, 1::FLOAT) WHEN n % 11 = 9 THEN NULL ELSE qvec END AS qvec,
  (n % 5)::INT AS cluster_id, [10, 0, 3, 600][n % 4 + 1]::INT AS top_k, [0, 1, 7][n % 3 + 1]::INT AS metric FROM (SELECT *, qid // 50 AS n FROM queries)),"""


def answers(limit: int | None, missing: int) -> str:
    """judged, hits and answers from requests."""
    top = "top_k" if limit is None else f"least(top_k, {limit})"
    both = "CASE WHEN metric = 1 THEN " + ip("qvec[8 * m + 1:8 * m + 8]", "c") + " ELSE " + l2("qvec[8 * m + 1:8 * m + 8]", "c") + " END"
    return f"""judged AS (SELECT *, CASE WHEN cluster_id NOT IN (SELECT cluster_id FROM lists) THEN {missing} WHEN qvec IS NULL OR len(qvec) < 64 THEN -22 ELSE 0 END AS status FROM requests),
lut AS (SELECT req, m, k, {both} AS d FROM judged, words WHERE status = 0),
tables AS (SELECT req, list(row ORDER BY m) AS t FROM (SELECT req, m, list(d ORDER BY k) AS row FROM lut GROUP BY req, m) GROUP BY req),
hits AS (SELECT req, rank, vector_id, distance FROM (SELECT req, vector_id, distance, wanted, row_number() OVER (PARTITION BY req ORDER BY distance, vector_id) AS rank
  FROM (SELECT j.req, {top} AS wanted, vector_id, {ADC} AS distance FROM judged j JOIN tables USING (req) JOIN lists l ON l.cluster_id = j.cluster_id)) WHERE rank <= wanted),
answers AS (SELECT j.req, status, coalesce(n, 0) AS count, rank, vector_id, distance FROM judged j LEFT JOIN (SELECT req, count(*) AS n FROM hits GROUP BY req) c ON j.req = c.req LEFT JOIN hits h ON j.req = h.req),"""


def semantic(metric: str) -> str:
    asked = f"requests AS (SELECT qid AS req, qvec, cluster_id, 600 AS top_k, {int(metric == 'ip')} AS metric FROM probes),"
    return _with(INDEX + probes(metric, 1) + asked + answers(500, -22), "SELECT req, status, count, rank, vector_id, distance FROM answers")


def lloyd(source: str, columns: str) -> str:
    """Updated means of `source` (columns, j, x), in fixed point."""
    return f"SELECT {columns}, j, (sum(floor(x::DOUBLE * 1048576)::BIGINT)::DOUBLE / count(*) / 1048576)::FLOAT AS value FROM {source} GROUP BY {columns}, j"


def _log(keys: int, shards: int) -> str:
    return f"""log AS MATERIALIZED (SELECT event_id, ts, (user_id % {keys})::INT AS cluster_id, (user_id % {keys} % {shards})::INT AS shard,
  CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS op, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events),"""


def _replay(keys: int, shards: int, slots: int) -> str:
    """Resident clusters before each access are the `slots` with the latest earlier accesses.

    Each access meets every cluster of its shard, so windows over (shard, cluster) tell when each was accessed before.
    """
    return _log(keys, shards) + f"""named AS MATERIALIZED (SELECT DISTINCT shard, cluster_id AS key FROM log),
earlier AS MATERIALIZED (SELECT l.event_id, l.shard, l.seq, l.cluster_id, l.op, k.key,
    max(CASE WHEN l.cluster_id = k.key THEN l.seq END)
      OVER (PARTITION BY k.shard, k.key ORDER BY l.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
  FROM log l JOIN named k ON l.shard = k.shard),
placed AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY last DESC) AS place FROM earlier WHERE last IS NOT NULL),
states AS MATERIALIZED (SELECT seq, max(place) FILTER (key = cluster_id AND place <= {slots}) AS own,
    max(key) FILTER (place = {slots}) AS lowest FROM placed GROUP BY seq),
replayed AS (SELECT l.*, own IS NOT NULL AS hit, CASE WHEN own IS NULL THEN lowest END AS evicted,
  CASE WHEN own = 1 THEN 0 WHEN own IS NOT NULL THEN 1 ELSE 2 END::INT AS priority FROM log l LEFT JOIN states ON l.seq = states.seq),"""


LOG, REPLAY = _log(97, 4), _replay(97, 4, 16)
RESIDENT = LOG + """last AS (SELECT shard, cluster_id, max(seq) AS last, arg_max(op, seq) = 'write' AS reload FROM log GROUP BY shard, cluster_id),
resident AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY last DESC) AS recency FROM last) WHERE recency <= 16),"""

EXACT = f"exact AS (SELECT qid, rank, vec_id AS global_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM (SELECT qid, vec_id, {l2('qvec', 'embedding')} AS distance FROM queries, embeddings)) WHERE rank <= 10),"


def nibbles(codes: str) -> str:
    """Two codes a byte, the first in the low half."""
    return f"list_transform(range(1, len({codes}) + 1, 2), lambda i: {codes}[i] + 16 * coalesce({codes}[i + 1], 0))"


def _length(a: str, b: str) -> str:
    """The distance of two lists in doubles."""
    return f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda j: ({a}[j]::DOUBLE - {b}[j]::DOUBLE) ** 2)))"


# Two rounds: the nearest clusters with ten vectors, then what the bounds leave. 136 / 2^24 is the rounding of a float32 sum of 64 squares.
SHARES = f"""decoded AS (SELECT vec_id, flatten(list(c ORDER BY w.m)) AS v FROM (SELECT vec_id, m::INT AS m, codes[m + 1] AS k FROM coded, range(8) t(m)) s JOIN words w ON s.m = w.m AND s.k = w.k GROUP BY vec_id),
placed AS (SELECT vec_id, cluster_id, embedding, v, {_length("embedding", "centroid")} AS reach, {_length("embedding", "v")} AS gap FROM embeddings JOIN assigned USING (vec_id) JOIN centroids USING (cluster_id) JOIN decoded USING (vec_id)),
rings AS (SELECT cluster_id, count(*) AS n, min(reach) AS low, max(reach) AS high FROM placed GROUP BY cluster_id),
far AS (SELECT qid, qvec, cluster_id, {_length("qvec", "centroid")} AS far FROM queries, centroids),
near AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY far, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 10 AS first FROM far JOIN rings USING (cluster_id)),
limits AS (SELECT qid, coalesce(list_sort(list(d))[10]::DOUBLE, 'inf'::DOUBLE) AS most FROM (SELECT qid, {l2("qvec", "embedding")} AS d FROM near JOIN placed USING (cluster_id) WHERE first) GROUP BY qid),
scanned AS (SELECT * FROM near JOIN limits USING (qid) WHERE first OR greatest(far - high, low - far, 0) ** 2 * (1 - 136 / 16777216.0::DOUBLE) <= most),
scored AS (SELECT s.qid, s.cluster_id, count(*) AS n FROM scanned s JOIN placed p USING (cluster_id)
  WHERE first OR (abs(reach - far) <= sqrt(most / (1 - 136 / 16777216.0::DOUBLE)) AND {_length("qvec", "v")} - gap <= sqrt(most / (1 - 136 / 16777216.0::DOUBLE))) GROUP BY s.qid, s.cluster_id),
"""


def _draw(round_: int) -> str:
    return f"('0x' || substr(sha256('{round_}:' || vec_id), 1, 8))::BIGINT::DOUBLE"


def starts(k: int = 4, rounds: int = 3, oversample: int = 2) -> str:
    """Candidates of each round, their weights, and the picks among them one after the other."""
    out = f"cand0 AS (SELECT vec_id, embedding AS v, 0 AS round FROM embeddings ORDER BY {_draw(0)}, vec_id LIMIT 1),"
    for r in range(1, rounds + 1):
        out += f"""cost{r} AS MATERIALIZED (SELECT e.vec_id, min(floor({l2("e.embedding", "c.v")}::DOUBLE * 1048576)::BIGINT) AS cost FROM embeddings e, cand{r - 1} c GROUP BY e.vec_id),
cand{r} AS MATERIALIZED (SELECT * FROM cand{r - 1} UNION ALL SELECT vec_id, embedding, {r} FROM embeddings JOIN cost{r} USING (vec_id)
  WHERE {_draw(r)} * (SELECT sum(cost)::DOUBLE FROM cost{r}) < cost::DOUBLE * {oversample * k << 32}::DOUBLE),"""
    out += f"""placed AS (SELECT *, row_number() OVER (ORDER BY round, vec_id) AS pos FROM cand{rounds}),
near AS (SELECT arg_min(pos, (d, pos)) AS pos FROM (SELECT e.vec_id, c.pos, {l2("e.embedding", "c.v")} AS d FROM embeddings e, placed c) GROUP BY vec_id),
weighed AS MATERIALIZED (SELECT p.vec_id, v, count(near.pos) AS weight FROM placed p LEFT JOIN near USING (pos) GROUP BY p.vec_id, v),
pick1 AS MATERIALIZED (SELECT 0 AS cluster_id, vec_id, weight, v FROM weighed ORDER BY weight DESC, vec_id LIMIT 1),"""
    for j in range(2, k + 1):
        out += f"""pick{j} AS MATERIALIZED (SELECT * FROM pick{j - 1} UNION ALL SELECT {j - 1}, vec_id, weight, v FROM (
  SELECT w.vec_id, w.weight, w.v, w.weight * min({l2("w.v", "p.v")}::DOUBLE) AS gain FROM weighed w, pick{j - 1} p GROUP BY w.vec_id, w.weight, w.v HAVING gain > 0 ORDER BY gain DESC, w.vec_id LIMIT 1)),"""
    return out


def _field(k: int) -> str:
    """A little-endian u32 of the header."""
    byte = lambda i: f"substr(content, {8 * k + 2 * i + 1}, 2)"
    return "('0x' || " + " || ".join(byte(i) for i in (3, 2, 1, 0)) + ")::BIGINT::HUGEINT"


ORACLES: dict[str, str] = {}
for _m in ("l2", "ip"):
    ORACLES |= {
        f"vector_{_m}_distance": _with(BASE, f"SELECT qid, vec_id, {DISTANCE[_m]('qvec', 'embedding')} AS distance FROM queries, embeddings"),
        f"centroid_select_{_m}": _with(BASE + probes(_m), "SELECT qid, rank, cluster_id, distance FROM probes"),
        f"adc_lut_{_m}": _with(BASE + luts(_m), "SELECT qid, m, k, d FROM lut"),
        f"adc_scan_{_m}": _with(INDEX + scanned(_m), "SELECT qid, cluster_id, vector_id, global_id, distance FROM scanned"),
        f"cluster_topk_{_m}": _with(INDEX + scanned(_m) + per_cluster(), "SELECT qid, cluster_id, rank, vector_id, global_id, distance FROM per_cluster"),
        f"ivfpq_search_{_m}": _with(INDEX + scanned(_m), gathered()),
        f"semantic_read_{_m}": semantic(_m),
    }
_COUNTERS = "(SELECT count(DISTINCT qid) FROM probes) AS queries, (SELECT count(*) FROM probes) AS probes, (SELECT count(*) FROM scanned) AS vectors, (SELECT count(*) * 8 FROM scanned) AS code_bytes"
ORACLES |= {
    "search_counters": " UNION ALL ".join(
        "SELECT * FROM (" + _with(INDEX + scanned(m) + f"found AS ({gathered()}),", f"SELECT '{m}' AS metric, {_COUNTERS}, (SELECT count(*) FROM found) AS hits") + ")" for m in ("l2", "ip")),
    "kernel_search": ORACLES["ivfpq_search_l2"],
    "centroid_tree": _with(BASE.replace("LIMIT 4)", "LIMIT 256)") + probes("l2", 4), "SELECT qid, rank, cluster_id, distance FROM probes"),
    "subvector_split": "SELECT vec_id, m::INT AS m, embedding[8 * m + 1:8 * m + 8] AS part FROM embeddings, range(8) t(m)",
    "centroid_distances": _with(BASE, f"SELECT qid, cluster_id, {l2('qvec', 'centroid')} AS l2, {ip('qvec', 'centroid')} AS ip FROM queries, centroids"),
    "scatter_gather_topk": _with(INDEX + scanned("l2") + per_cluster(), gathered(10, "(SELECT * EXCLUDE (rank) FROM per_cluster)")),
    "adc_exhaustive_topk": _with(INDEX + scanned("l2", 4), gathered()),
    "device_search": _with(INDEX + REQUESTS + answers(None, -2), "SELECT req, status, count, rank, vector_id, distance FROM answers"),
    "search_status": _with(INDEX + REQUESTS + answers(None, -2), "SELECT req, cluster_id, top_k, metric, status FROM judged"),
    "topk_clamp": _with(BASE + CODED.split("lists AS")[0] + "lists AS (SELECT 0 AS cluster_id, 2 * vec_id + copy AS vector_id, vec_id AS global_id, codes FROM coded, range(2) t(copy)),"
        + "requests AS (SELECT qid AS req, qvec, 0 AS cluster_id, 600 AS top_k, 0 AS metric FROM queries)," + answers(500, -2), "SELECT req, count, rank, vector_id, distance FROM answers"),
    "ivf_assign": _with(BASE + ASSIGNED, "SELECT vec_id, cluster_id FROM assigned"),
    "ivf_list_sizes": _with(BASE + ASSIGNED, "SELECT cluster_id, count(*) AS n_vectors FROM assigned GROUP BY cluster_id"),
    "inverted_lists": _with(INDEX, "SELECT cluster_id, vector_id, global_id, codes FROM lists"),
    "bounded_lists": "SELECT count(*) AS n_vectors, 0::BIGINT AS too_long FROM embeddings",  # where they lie is tested against a loop
    "appended_lists": _with(INDEX, "SELECT cluster_id, vector_id, global_id, codes FROM lists"),
    "pq_encode": _with(INDEX, "SELECT vec_id, codes FROM coded"),
    "pq_code_unpack": _with(INDEX, f"SELECT vec_id, {nibbles('codes')} AS packed, codes, {nibbles('part')} AS part_packed, part AS part_codes FROM (SELECT *, CASE WHEN vec_id % 10 != 9 THEN codes[:vec_id % 9] END AS part FROM coded)"),
    "kmeans_step": _with(BASE + ASSIGNED + "parts AS (SELECT cluster_id, unnest(range(64))::INT AS j, unnest(embedding) AS x FROM assigned JOIN embeddings USING (vec_id)), means AS (" + lloyd("parts", "cluster_id") + "),",
        "SELECT c.cluster_id, c.j, coalesce(value, x) AS value FROM (SELECT cluster_id, unnest(range(64))::INT AS j, unnest(centroid) AS x FROM centroids) c LEFT JOIN means m ON c.cluster_id = m.cluster_id AND c.j = m.j"),
    "pq_train_step": _with(INDEX + "parts AS (SELECT m::INT AS m, codes[m + 1] AS k, unnest(range(8))::INT AS j, unnest(embedding[8 * m + 1:8 * m + 8]) AS x FROM coded JOIN embeddings USING (vec_id), range(8) t(m)), means AS (" + lloyd("parts", "m, k") + "),",
        "SELECT c.m, c.k, c.j, coalesce(value, x) AS value FROM (SELECT m, k, unnest(range(8))::INT AS j, unnest(c) AS x FROM words) c LEFT JOIN means ON c.m = means.m AND c.k = means.k AND c.j = means.j"),
    "kmeans_starts": _with(starts(), "SELECT cluster_id, vec_id, weight, v AS centroid FROM pick4"),
    "cluster_object_size": _with(BASE + ASSIGNED, "SELECT cluster_id, count(*) AS n_vectors, 28 + 4 * 8 * 16 * 8 + 8 * count(*) AS object_bytes FROM assigned GROUP BY cluster_id"),
    "index_metadata": "SELECT json_object('M', 8, 'ksub', 16, 'D', 64, 'dsub', 8, 'num_vectors', count(*), 'num_queries', count(*) FILTER (vec_id % 50 = 0), 'top_k', 10, 'metric_type', 0)::VARCHAR AS metadata FROM embeddings",
    "blob_validate": _with(_cases("content", BLOB_CASES), f"SELECT case_id, CASE WHEN content IS NULL OR len(content) < 56 THEN -22 WHEN {_field(0)} <> 1129337088 OR {_field(1)} <> 1 THEN -22 WHEN len(content) // 2 < 28 + 4 * {_field(2)} * {_field(3)} * {_field(5)} + {_field(6)} * {_field(2)} THEN -22 ELSE 0 END AS status FROM cases"),
    "blob_roundtrip": _with(INDEX, "SELECT cluster_id, vector_id, codes FROM lists"),
    "blob_scan": _with(INDEX, "SELECT cluster_id, vector_id, codes FROM lists"),
    "raw_vectors": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, embedding AS elements FROM embeddings",
    "raw_codes": _with(INDEX, "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, codes AS elements FROM coded"),
    "golden_topk_records": _with(INDEX + scanned("l2", 4) + f"hits AS ({gathered()}),",
        "SELECT dense_rank() OVER (ORDER BY qid) - 1 AS query, rank, global_id AS vector_id, distance FROM hits"),
    "semantic_write_overwrite": _with(INDEX, "SELECT cluster_id, CASE WHEN cluster_id = 2 THEN vector_id // 2 ELSE vector_id END AS vector_id, global_id, codes FROM lists WHERE cluster_id <> 2 OR vector_id % 2 = 0"),
    "versioned_overwrite": _with(INDEX, "SELECT 1 AS version, cluster_id, vector_id, global_id, codes FROM lists UNION ALL SELECT 2, cluster_id, CASE WHEN cluster_id = 2 THEN vector_id // 2 ELSE vector_id END, global_id, codes FROM lists WHERE cluster_id <> 2 OR vector_id % 2 = 0"),
    "cluster_extents": _with(BASE + ASSIGNED, "SELECT cluster_id, count(*) AS n_vectors, true AS on_disk FROM assigned GROUP BY cluster_id"),
    "golden_compare": _with(INDEX + luts("l2") + "decoded AS (SELECT vec_id, flatten(list(c ORDER BY w.m)) AS v FROM (SELECT vec_id, m::INT AS m, codes[m + 1] AS k FROM coded, range(8) t(m)) s JOIN words w ON s.m = w.m AND s.k = w.k GROUP BY vec_id),"
        + f"gaps AS (SELECT q.qid, d.vec_id AS global_id, abs({ADC} - {l2('qvec', 'v')}) AS gap FROM queries q JOIN tables USING (qid), decoded d JOIN coded USING (vec_id)),",
        "SELECT qid, max(gap) AS max_gap, arg_min(global_id, (-gap, global_id)) AS worst_id, max(gap) > 1e-6 AS differs FROM gaps GROUP BY qid"),
    "metric_divergence": _with(INDEX + scanned("l2", 4).replace("probes AS", "probes_l2 AS").replace("FROM probes p", "FROM probes_l2 p").replace("lut AS", "lut_l2 AS").replace("FROM lut ", "FROM lut_l2 ").replace("tables AS", "tables_l2 AS").replace("JOIN tables", "JOIN tables_l2").replace("scanned AS", "scanned_l2 AS") + scanned("ip", 4)
        + f"a AS ({gathered(10, 'scanned_l2')}), b AS ({gathered()}),", "SELECT a.qid, bool_or(a.global_id <> b.global_id) AS differs FROM a JOIN b ON a.qid = b.qid AND a.rank = b.rank GROUP BY a.qid"),
    "exact_knn": _with(BASE + EXACT, "SELECT qid, rank, global_id, distance FROM exact"),
    "packed_search_l2": ORACLES["ivfpq_search_l2"],
    "packed_search_ip": ORACLES["ivfpq_search_ip"],
    "packed_code_bytes": _with(BASE + ASSIGNED, "SELECT cluster_id, count(*) AS n_vectors, count(*) * 4 AS code_bytes FROM assigned GROUP BY cluster_id"),
    "bounded_search": _with(BASE + EXACT, "SELECT qid, rank, global_id, distance FROM exact"),
    "bounded_shares": _with(INDEX + SHARES, """SELECT s.qid, count(*) FILTER (first) AS first_clusters, coalesce(sum(c.n) FILTER (first), 0)::BIGINT AS first_vectors, count(*) FILTER (NOT first) AS more_clusters,
  coalesce(sum(c.n) FILTER (NOT first), 0)::BIGINT AS more_vectors, coalesce(sum(c.n), 0)::DOUBLE / (SELECT count(*) FROM placed) AS share FROM scanned s LEFT JOIN scored c ON s.qid = c.qid AND s.cluster_id = c.cluster_id GROUP BY s.qid"""),
    # Brute force: the index search has to find every neighbour here. What it finds on larger tables is tested apart.
    "refined_search": _with(BASE + EXACT, "SELECT qid, rank, global_id, distance FROM exact"),
    "ivfpq_recall": _with(INDEX + scanned("l2") + f"found AS ({gathered()})," + EXACT, "SELECT e.qid, count(f.global_id)::DOUBLE / count(*) AS recall FROM exact e LEFT JOIN found f ON e.qid = f.qid AND e.global_id = f.global_id GROUP BY e.qid"),
    "lru_hit_miss": _with(REPLAY, "SELECT event_id, shard, cluster_id, op, hit FROM replayed"),
    "lru_evictions": _with(REPLAY, "SELECT event_id, shard, cluster_id, evicted FROM replayed WHERE evicted IS NOT NULL"),
    "opwq_priority": _with(REPLAY, "SELECT event_id, shard, priority FROM replayed"),
    "cache_counters": _with(REPLAY, "SELECT shard, count(*) FILTER (op = 'read') AS reads, count(*) FILTER (op = 'write') AS writes, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(evicted) AS evictions FROM replayed GROUP BY shard"),
    "centroid_cache": _with(_replay(12, 1, 4), "SELECT event_id, cluster_id AS index_id, hit, evicted AS evicted_index FROM replayed"),
    "cache_resident_set": _with(RESIDENT, "SELECT shard, cluster_id, recency FROM resident"),
    "codebook_reload_flag": _with(RESIDENT, "SELECT shard, cluster_id, reload FROM resident"),
    "last_cluster_id": _with(LOG, "SELECT shard, arg_max(cluster_id, seq) AS last_cluster_id FROM log WHERE op = 'read' GROUP BY shard"),
    "config_parse": _with(_cases("config", CONFIG_CASES) + """, read AS (SELECT case_id, config, json_valid(config) AS fine, CASE WHEN json_valid(config) THEN json_extract_string(config, '$.max_cache_slots') END AS raw,
  CASE WHEN json_valid(config) THEN json_extract_string(config, '$.hw_lib_path') END AS path FROM cases),
judged AS (SELECT *, config IS NULL OR (fine AND (raw IS NULL OR try_cast(raw AS INT) IS NOT NULL)) AS good FROM read)""",
        "SELECT case_id, CASE WHEN good THEN 0 ELSE -22 END AS status, CASE WHEN good THEN CASE WHEN try_cast(raw AS INT) > 0 THEN try_cast(raw AS INT) ELSE 64 END END AS max_cache_slots, CASE WHEN good THEN coalesce(path, '') END AS hw_lib_path FROM judged"),
    "api_version": "SELECT 1 AS api_version",
}
