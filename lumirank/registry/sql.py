"""The registered queries as SQL over the same tables, for a comparison with another engine."""

from __future__ import annotations

from lumirank.functions.pixels import MEAN, STD

_MEAN = "[" + ", ".join(repr(m) for m in MEAN) + "]"
_STD = "[" + ", ".join(repr(s) for s in STD) + "]"

_PAIRS = """
    SELECT q.vec_id AS query_id, c.vec_id AS id, c.label,
           round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS s
    FROM embeddings q, embeddings c"""


def _top(k: int, where: str = "") -> str:
    return f"""
    SELECT query_id, rank, id, round(s, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank
      FROM ({_PAIRS}) {where}) WHERE rank <= {k}"""


_LATEST = """
    SELECT event_type AS namespace, 'u' || user_id AS id, event_id, round(value::FLOAT::DOUBLE, 2) AS value,
           'images/' || event_type || '/u' || user_id AS image_path,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS preprocess_time
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1"""


def _sessions(key: str, gap: str, closes: str) -> str:
    """Events with the running number of their session."""
    over = f"PARTITION BY {key} ORDER BY ts, event_id" if key else "ORDER BY ts, event_id"
    return f"""
    SELECT *, sum(fresh) OVER ({over} ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER ({over}) {closes} INTERVAL {gap} THEN 1
                     WHEN lag(ts) OVER ({over}) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)"""


def _batches(key: str, gap: str, size: int, where: str = "") -> str:
    part = f"{key}, session" if key else "session"
    first = f"{key}, " if key else ""
    return f"""
    SELECT {first}event_id AS id, ts, session, (place // {size})::BIGINT AS part, (place % {size})::BIGINT AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY ts, event_id) - 1 AS place
      FROM ({_sessions(key, gap, '>=')})) {where}"""


_SESSION_WINDOWS = f"""
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS arrivals
    FROM ({_sessions('user_id', '6 HOUR', '>')}) GROUP BY user_id, session"""

# What a watermark without delay has passed at the end of the table, to the millisecond.
_WATERMARK = "(SELECT date_trunc('milliseconds', max(ts)) FROM events)"

_TEN = "time_bucket(INTERVAL 10 MINUTE, ts)"


def _periods(counts: str) -> str:
    return f"""
    WITH c AS ({counts})
    SELECT p AS period_start, coalesce(c.n, 0) AS arrivals, round(coalesce(c.n, 0) / 600.0::DOUBLE, 8) AS rate
    FROM (SELECT unnest(generate_series((SELECT min(w) FROM c), (SELECT max(w) FROM c), INTERVAL 10 MINUTE)) AS p)
    LEFT JOIN c ON c.w = p"""


_HOURLY = """
    WITH c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY 1),
    hourly AS (SELECT (epoch_us(p) // 3600000000)::BIGINT AS line_number, coalesce(c.n, 0)::DOUBLE AS throughput
      FROM (SELECT unnest(generate_series((SELECT min(w) FROM c), (SELECT max(w) FROM c), INTERVAL 1 HOUR)) AS p)
      LEFT JOIN c ON c.w = p)"""

_ROW_JSON = """'{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type
    || '","props":"' || replace(props, '"', '\\"') || '"'"""

_SUMMARY = """count(*) AS total, count(*) FILTER (event_type <> 'error') AS successes,
    count(*) FILTER (event_type = 'error') AS failures, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS duration_s,
    round(CASE WHEN max(ts) > min(ts) THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE) END, 9) AS requests_per_s"""


def _buckets(table: str, key: str) -> str:
    return f"""
    SELECT id, (('0x' || substr(md5(t), 1, 8))::BIGINT % 512)::INTEGER AS bucket, count(*) AS n FROM (
      SELECT {key} AS id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS t FROM {table}) WHERE t <> ''
    GROUP BY ALL"""


def _text_search(k: int, id_: str = "id", more: str = "") -> str:
    return f"""
    WITH dv AS ({_buckets('documents', 'doc_id')}), qv AS ({_buckets('benchmark', 'item_id')}),
    dn AS (SELECT id, sqrt(sum(n * n)) AS l FROM dv GROUP BY id), qn AS (SELECT id, sqrt(sum(n * n)) AS l FROM qv GROUP BY id),
    pairs AS (SELECT qv.id AS query_id, dv.id AS id, sum(qv.n * dv.n) AS dot FROM qv JOIN dv USING (bucket) GROUP BY ALL),
    scored AS (SELECT query_id, pairs.id, round(dot / (qn.l * dn.l), 12) AS s FROM pairs
      JOIN qn ON qn.id = query_id JOIN dn ON dn.id = pairs.id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored)
    SELECT query_id, rank, {id_} AS id, round(s, 6) AS score{more} FROM ranked WHERE rank <= {k}"""


_RGBA = "SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::INTEGER) AS b FROM embeddings"

# Those of the vectors' images that are files: size, stored bytes from top to bottom, and size of the tensor.
_IMAGE_FILES = f"""
    SELECT vec_id, CASE WHEN label = 1 THEN -1 ELSE 4 END AS height, CASE WHEN label = 1 THEN -1 ELSE 3 END AS channels,
           CASE WHEN label = 1 THEN '' ELSE p END AS pixels, CASE WHEN label = 1 THEN 0 ELSE 48 END AS n, label = 1 AS bad
    FROM (SELECT vec_id, string_agg(format('{{:02X}}', b[i + 1]), '' ORDER BY i) AS p
          FROM ({_RGBA}), unnest(range(64)) AS t(i) WHERE i % 4 < 3 GROUP BY vec_id) JOIN embeddings USING (vec_id) WHERE label <> 0"""

# Pages as images 16 wide: one row per stored byte (row y, column x, channel c in red, green, blue).
_PAGE_PIXELS = """
    SELECT page_id AS id, h, (i // 48)::BIGINT AS y, ((i % 48) // 3)::BIGINT AS x, (2 - i % 3)::BIGINT AS c,
           coalesce(('0x' || nullif(substr(hx, (2 * i + 1)::BIGINT, 2), ''))::BIGINT, 0) AS v
    FROM (SELECT page_id, hex(encode(html)) AS hx, ((octet_length(encode(html)) + 47) // 48)::BIGINT AS h FROM pages),
         unnest(range(h * 48)) AS t(i)"""


def _weights(sizes: str) -> str:
    """Whole-number cubic weights: for each (key, n_in, n_out, first) the taps of eight output pixels."""
    return f"""
    SELECT key, o, r, trunc(w / total * 4194304.0 + CASE WHEN w < 0 THEN -0.5 ELSE 0.5 END)::BIGINT AS k FROM (
      SELECT *, sum(w) OVER (PARTITION BY key, o) AS total FROM (
        SELECT key, o, r, CASE WHEN a < 1 THEN ((1.5 * a) - 2.5) * a * a + 1 WHEN a < 2 THEN (((a - 5) * a + 8) * a - 4) * -0.5 ELSE 0 END AS w
        FROM (SELECT key, o, r, abs((r - center + 0.5) / st) AS a
          FROM (SELECT key, o, center, st, greatest(trunc(center - 2 * st + 0.5), 0)::BIGINT AS lo,
                       least(trunc(center + 2 * st + 0.5), n_in)::BIGINT AS hi
            FROM (SELECT key, n_in, o, (first + o + 0.5::DOUBLE) * (n_in::DOUBLE / n_out) AS center, greatest(n_in::DOUBLE / n_out, 1.0::DOUBLE) AS st
              FROM ({sizes}), unnest(range(8)) AS t(o))), unnest(range(lo, hi)) AS u(r))))"""


def _resampled(pixels: str, across: str, down: str) -> str:
    """Pixels (id, h, y, x, c, v) to (id, y, x, c, v) of 8 × 8: across first, then down, rounded each time.

    `across` and `down` give the sizes by h. Sums may be negative, so the shift by 22 bits is written as a floor.
    """
    return f"""
    px AS MATERIALIZED ({pixels}), wx AS MATERIALIZED ({_weights(across)}), wy AS MATERIALIZED ({_weights(down)}),
    p1 AS MATERIALIZED (SELECT id, h, y, o AS x, c, greatest(0, least(255, floor((sum(v * k) + 2097152) / 4194304.0)))::BIGINT AS v
           FROM px JOIN wx ON wx.key = px.h AND wx.r = px.x GROUP BY ALL),
    p2 AS MATERIALIZED (SELECT id, o AS y, x, c, greatest(0, least(255, floor((sum(v * k) + 2097152) / 4194304.0)))::BIGINT AS v
           FROM p1 JOIN wy ON wy.key = p1.h AND wy.r = p1.y GROUP BY ALL)"""


def _page_side(side: str) -> str:
    """The pages' images are 16 wide and h high: the shorter side gets 8 pixels, of the other the middle 8 stay."""
    return f"""
    SELECT h AS key, n_in, n_out, round_even((n_out - 8) / 2.0, 0)::BIGINT AS first FROM (
      SELECT h, {side} AS n_in, trunc(8 * {side} / least(16, h)::DOUBLE)::BIGINT AS n_out FROM (
        SELECT DISTINCT ((octet_length(encode(html)) + 47) // 48)::BIGINT AS h FROM pages))"""


_FOUR_TO_EIGHT = "SELECT 4 AS key, 4 AS n_in, 8 AS n_out, 0 AS first"


# Premultiplied pixels of the small images, channels in red, green, blue, alpha.
_RGBA_PIXELS = f"""
    SELECT id, 4::BIGINT AS h, y, x, c, CASE WHEN c = 3 THEN a ELSE ((m >> 8) + m) >> 8 END AS v FROM (
      SELECT id, y, x, c, a, v * a + 128 AS m FROM (
        SELECT vec_id AS id, (i // 16)::BIGINT AS y, ((i % 16) // 4)::BIGINT AS x, c::BIGINT AS c,
               b[(i // 4) * 4 + (CASE WHEN c = 3 THEN 3 ELSE 2 - c END) + 1]::BIGINT AS v, b[(i // 4) * 4 + 4]::BIGINT AS a
        FROM ({_RGBA}), unnest(range(0, 64, 4)) AS t(i), unnest(range(4)) AS u(c)))"""


_PAGE_STORED = f"WITH {_resampled(_PAGE_PIXELS, _page_side('16'), _page_side('h'))}"


_BLOCK_SUMS = f"""{_PAGE_STORED}
    SELECT id AS page_id, (c * 4 + (y // 4) * 2 + x // 4)::INTEGER AS pos, sum(v)::INTEGER AS bytes FROM p2 GROUP BY ALL"""

_DELIVERY = f"""count(*) AS messages, count(*) FILTER (event_type IN ('click', 'signup')) AS errors,
    sum(CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN l + 1 ELSE l END)::BIGINT AS bytes
    FROM (SELECT event_type, octet_length(encode(base64(encode({_ROW_JSON} || '}}')))) AS l FROM events)"""


def oracle_sql() -> dict[str, str]:
    return {
        "topk_cosine": _top(5),
        "topk_cell_join": _top(5),
        "topk_many_queries": _top(5),
        "topk_grid": _top(5),
        "topk_approx": _top(5),
        "topk_stored": _top(5),
        "topk_probed": _top(1),
        "topk_approx_recall": f"SELECT count(*) AS neighbours, true AS enough FROM ({_top(5)})",
        "topk_in_namespace": _top(3, "WHERE label = 3"),
        "topk_with_values": f"""
            SELECT query_id, rank, id, round(list_sum(embedding::DOUBLE[]), 5) AS total
            FROM ({_top(2)}) JOIN embeddings ON vec_id = id""",
        "cosine_to_label_mean": """
            WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, unnest(range(64)) AS pos FROM embeddings),
            m AS (SELECT label, list(a ORDER BY pos) AS mean FROM (SELECT label, pos, avg(e[pos + 1]) AS a FROM v GROUP BY ALL) GROUP BY label)
            SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS score FROM embeddings JOIN m USING (label)""",
        "vector_profile": """
            SELECT label, count(*) AS records, min(len(embedding))::INTEGER AS smallest, max(len(embedding))::INTEGER AS largest,
                   round(sum(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS squares
            FROM embeddings GROUP BY label""",
        "vector_dimension": "SELECT max(len(embedding))::INTEGER AS dimension, count(*) AS records FROM embeddings",
        "vector_normalize": """
            WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3 + 1) AS e FROM embeddings)
            SELECT vec_id, pos::INTEGER AS pos, round(e[pos + 1] / sqrt(list_inner_product(e, e)), 6) AS v FROM t, unnest(range(64)) AS u(pos)""",
        "vector_conversion": """
            SELECT vec_id, len(embedding)::INTEGER AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings""",
        "check_dimension": """
            SELECT vec_id, CASE label WHEN 7 THEN 'dimension 63, expected 64' WHEN 8 THEN 'dimension -1, expected 64' ELSE 'ok' END AS reason
            FROM embeddings""",
        "valid_embeddings": """
            SELECT vec_id, CASE WHEN label IN (7, 8) THEN 'no embedding returned' ELSE 'ok' END AS reason FROM embeddings""",
        "no_match_report": "SELECT vec_id AS query_id, 'no matches found' AS reason FROM embeddings WHERE label = 4",
        "upsert_latest": _LATEST,
        "upsert_rewritten": f"SELECT * REPLACE (-value AS value) FROM ({_LATEST})",
        "upsert_replayed": _LATEST,
        "read_namespace": f"SELECT * FROM ({_LATEST}) WHERE namespace = 'purchase'",
        "collection_describe": """
            SELECT 'vectors' AS name, 64 AS dimension, 'cosine' AS metric, 'label-' || label AS namespace, count(*) AS records,
                   min(len(embedding))::INTEGER AS smallest, max(len(embedding))::INTEGER AS largest FROM embeddings GROUP BY label""",
        "record_id": "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS id FROM pages",
        "record_metadata": """
            SELECT event_id, 'images/' || event_type || '.png' AS image_path,
                   strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS preprocess_time, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso_time FROM events""",
        "format_match": """
            SELECT event_id, path, 'Original query: ' || event_type || chr(10) || ' Displayed `' || path || '` (score: ' || format('{:.4f}', value) || ')' AS text
            FROM (SELECT *, CASE WHEN event_type <> 'view' THEN 'images/' || event_type ELSE user_id::VARCHAR END AS path FROM events)""",
        "resolve_existing_path": """
            WITH d AS (SELECT doc_id, source || '/' || lang || '-' || (doc_id % 97) || '.txt' AS image_path,
                              'images/' || lang || '-' || (doc_id % 97) || '.txt' AS local, n_chars FROM documents),
            f AS (SELECT DISTINCT CASE WHEN n_chars % 2 = 0 THEN image_path WHEN n_chars % 3 = 0 THEN local END AS path FROM d)
            SELECT doc_id, image_path, coalesce(a.path, b.path) AS found_path
            FROM d LEFT JOIN f a ON a.path = d.image_path LEFT JOIN f b ON b.path = d.local""",
        "micro_batches": _batches("user_id", "6 HOUR", 3),
        "micro_batches_unkeyed": _batches("", "10 MINUTE", 50),
        "session_windows": _SESSION_WINDOWS,
        "throughput_windows": _periods(f"SELECT {_TEN} AS w, count(*) AS n FROM events GROUP BY 1"),
        "moving_average": f"""{_HOURLY}
            SELECT line_number, round(m, 6) AS moving_average FROM (
              SELECT line_number, avg(throughput) OVER w AS m, count(*) OVER w AS n FROM hourly
              WINDOW w AS (ORDER BY line_number ROWS 4 PRECEDING)) WHERE n = 5""",
        "moving_average_by_type": """
            SELECT event_type, event_id, round(m, 6) AS moving_average FROM (
              SELECT event_type, event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events
              WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS 4 PRECEDING)) WHERE n = 5""",
        "throughput_stats": f"""{_HOURLY}
            SELECT *, 'Max: ' || format('{{:.2f}}', largest) || ' req/sec' || chr(10) || 'Min: ' || format('{{:.2f}}', smallest)
                   || ' req/sec' || chr(10) || 'Avg: ' || format('{{:.2f}}', average) || ' req/sec' AS stats_text
            FROM (SELECT count(*) AS points, round(avg(throughput), 6) AS average, max(throughput) AS largest, min(throughput) AS smallest FROM hourly)""",
        "run_summary": f"SELECT {_SUMMARY} FROM events",
        "run_summary_by_user": f"SELECT user_id, {_SUMMARY} FROM events GROUP BY user_id",
        "failure_breakdown": """
            SELECT 'code ' || (user_id % 7) AS error_info, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1""",
        "log_throughput": """
            SELECT position, format('{:.2f}', value)::DOUBLE AS throughput FROM (
              SELECT *, row_number() OVER (ORDER BY ts, event_id) AS position FROM events)
            WHERE event_type = 'view'""",
        "batch_assign": """
            SELECT doc_id, position, (position // 50)::BIGINT AS batch FROM (
              SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)""",
        "batch_count": "SELECT count(*) AS queries, ((count(*) + 49) // 50)::BIGINT AS batches FROM conversations",
        "encode_rows": f"""
            SELECT user_id::VARCHAR AS key, base64(encode({_ROW_JSON} || '}}')) AS value, 'schema,format' AS header_names,
                   'json_base64' AS format FROM events""",
        "encode_rows_indexed": """
            SELECT event_id::VARCHAR AS key, event_id, 'events' AS source, row_number() OVER (ORDER BY event_id) - 1 AS row_index,
                   '2024-02-03T04:05:06.000007' AS timestamp FROM events""",
        "decode_roundtrip": "SELECT * FROM events",
        "decode_failures": """
            SELECT CASE event_type WHEN 'click' THEN 'not base64' WHEN 'signup' THEN 'empty message' ELSE 'ok' END AS reason,
                   count(*) AS messages FROM events GROUP BY 1""",
        "delivery_stats": f"SELECT event_type AS topic, {_DELIVERY} GROUP BY 1",
        "stream_delivery": f"SELECT {_DELIVERY}",
        "stream_delivery_reports": f"SELECT {_DELIVERY}",
        "encode_json": f"""SELECT {_ROW_JSON} || ',"timestamp":"2024-02-03T04:05:06.000007"}}' AS value FROM events""",
        "decode_json": "SELECT * FROM events",
        "decode_json_any": """
            SELECT event_id, CASE WHEN ok THEN event_id END AS id, CASE WHEN ok THEN user_id END AS user, CASE WHEN ok THEN event_type END AS did,
                   CASE WHEN ok THEN regexp_extract(props, '([0-9]+)', 1)::BIGINT END AS k, NULL::VARCHAR AS extra,
                   CASE event_type WHEN 'click' THEN 'not JSON' WHEN 'signup' THEN 'not a row' END AS error
            FROM (SELECT *, event_type NOT IN ('click', 'signup') AS ok FROM events)""",
        **dict.fromkeys(("published_messages", "published_again", "stream_published"), """
            SELECT event_id::VARCHAR AS key, 'events' AS topic, event_id, user_id, event_type, props FROM events"""),
        "row_index": """
            SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders""",
        "row_index_sliced": """
            SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders""",
        "split_rejects": """
            SELECT doc_id, CASE WHEN lang = 'de' OR coalesce(length(source), 0) = 0 THEN 'missing image.origin'
                                WHEN n_chars % 7 = 0 THEN 'missing tensors' ELSE 'ok' END AS reason FROM documents""",
        "valid_queries": """
            WITH q AS (SELECT conv_id * 1000 + turn AS query_id,
                CASE WHEN role = 'user' AND turn % 2 = 0 THEN ' ' || chr(12288) ELSE chr(160) || ' ' || text || ' ' || chr(8201) END AS raw FROM conversations),
            t AS (SELECT query_id, raw, regexp_replace(raw, '^[\\s\\x{a0}\\x{2009}\\x{3000}]+|[\\s\\x{a0}\\x{2009}\\x{3000}]+$', '', 'g') AS stripped FROM q)
            SELECT query_id, CASE WHEN coalesce(stripped, '') = '' THEN length(raw) ELSE length(stripped) END::INTEGER AS n,
                   CASE WHEN coalesce(stripped, '') = '' THEN 'no text provided' ELSE 'ok' END AS reason,
                   CASE WHEN coalesce(stripped, '') = '' THEN 400 ELSE 200 END AS code FROM t""",
        "text_embed": f"SELECT id AS doc_id, bucket, n FROM ({_buckets('documents', 'doc_id')})",
        "text_embed_batched": f"SELECT id AS doc_id, bucket, n FROM ({_buckets('documents', 'doc_id')})",
        "text_search_top1": _text_search(1),
        "text_search_top10": _text_search(10),
        "topk_sparse": _text_search(10),
        "normalize_pixels_sql": f"""
            SELECT vec_id, pos::INTEGER AS pos, round((b[(pos % 16) * 4 + pos // 16 + 1] / 255.0::DOUBLE - {_MEAN}[pos // 16 + 1]) / {_STD}[pos // 16 + 1], 6) AS v
            FROM ({_RGBA}), unnest(range(48)) AS t(pos)""",
        "preprocess_rgba": f"""
            WITH {_resampled(_RGBA_PIXELS, _FOUR_TO_EIGHT, _FOUR_TO_EIGHT)},
            al AS (SELECT id, y, x, v AS a FROM p2 WHERE c = 3)
            SELECT id AS vec_id, (c * 64 + y * 8 + x)::INTEGER AS pos,
                   (CASE WHEN a = 0 OR a = 255 THEN v ELSE least(255, (255 * v) // a) END)::INTEGER AS byte
            FROM p2 JOIN al USING (id, y, x) WHERE c < 3""",
        "preprocess_rgb": f"""{_PAGE_STORED}
            SELECT id AS page_id, (c * 64 + y * 8 + x)::INTEGER AS pos, v::INTEGER AS byte FROM p2""",
        "preprocess_rows": """
            SELECT page_id, url AS image_path, url AS origin, ((octet_length(encode(html)) + 47) // 48)::INTEGER AS height, 16 AS width,
                   3 AS "nChannels", 16 AS mode, 150528 AS n, TIMESTAMP '2024-01-01' AS preprocess_time, NULL::VARCHAR AS error FROM pages""",
        "bad_images": """
            SELECT page_id, CASE WHEN ((octet_length(encode(html)) + 47) // 48) % 2 = 1 THEN 'missing tensors' ELSE 'ok' END AS reason FROM pages""",
        "strip_image_pixels": """
            SELECT page_id, url AS image_path, url AS origin, ((octet_length(encode(html)) + 47) // 48)::INTEGER AS height, 16 AS width,
                   3 AS "nChannels", 16 AS mode FROM pages""",
        "tensor_to_image": f"""{_PAGE_STORED},
            n AS (SELECT id, y, x, c, ((v::FLOAT / 255::FLOAT) - ({_MEAN})[c + 1]::FLOAT) / ({_STD})[c + 1]::FLOAT AS t FROM p2),
            b AS (SELECT id, y, x, c, trunc(greatest(0::FLOAT, least(1::FLOAT, t * ({_STD})[c + 1]::FLOAT + ({_MEAN})[c + 1]::FLOAT)) * 255::FLOAT)::INTEGER AS v FROM n)
            SELECT id AS page_id, url AS origin, 8 AS height, 16 AS mode, string_agg(format('{{:02X}}', v), '' ORDER BY y, x, c DESC) AS data
            FROM b JOIN pages ON page_id = id GROUP BY ALL""",
        "read_image_files": _IMAGE_FILES,
        "stream_image_files": _IMAGE_FILES,
        "resolve_image_files": "SELECT vec_id, label <> 0 AS there FROM embeddings",
        "embed_images": f"""
            WITH b AS MATERIALIZED ({_BLOCK_SUMS}),
            m AS (SELECT page_id, pos, (bytes / 16.0::DOUBLE / 255 - {_MEAN}[pos // 4 + 1]) / {_STD}[pos // 4 + 1] AS v FROM b),
            s AS (SELECT i, j, CASE WHEN ('0x' || md5('0-' || i || '-' || j)[1])::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS sign
                  FROM range(12) a(i), range(16) c(j))
            SELECT page_id, j::INTEGER AS pos, round(sum(v * sign)::FLOAT::DOUBLE, 3) AS v FROM m JOIN s ON i = pos GROUP BY page_id, j""",
        "embed_image_blocks": _BLOCK_SUMS,
        "embed_images_one_pass": _BLOCK_SUMS,
        "stream_ingest_images": _BLOCK_SUMS,
        "image_ingest": """
            SELECT 'images' AS name, 64 AS dimension, 'cosine' AS metric, 'image_embeddings' AS namespace, count(*) AS records,
                   64 AS smallest, 64 AS largest FROM pages""",
        "stream_consume": _LATEST,
        "stream_replayed": _LATEST,
        "stream_micro_batches": _batches("user_id", "6 HOUR", 3, f"WHERE ts < {_WATERMARK}"),
        "stream_micro_batches_files": _batches("user_id", "6 HOUR", 3),
        "stream_sessions": f"SELECT * FROM ({_SESSION_WINDOWS}) WHERE session_end <= {_WATERMARK}",
        "stream_throughput": _periods(
            f"SELECT * FROM (SELECT {_TEN} AS w, count(*) AS n FROM events GROUP BY 1) WHERE w + INTERVAL 10 MINUTE <= {_WATERMARK}"
        ),
        "stream_micro_batches_final": _batches("user_id", "6 HOUR", 3),
        "stream_micro_batches_bounded": f"""
            SELECT * REPLACE (epoch_us(min(ts) OVER (PARTITION BY user_id, session)) AS session) FROM ({_batches("user_id", "6 HOUR", 3)})""",
        "stream_throughput_live": _periods(f"SELECT {_TEN} AS w, count(*) AS n FROM events GROUP BY 1"),
        "stream_sessions_final": _SESSION_WINDOWS,
        "stream_throughput_final": _periods(f"SELECT {_TEN} AS w, count(*) AS n FROM events GROUP BY 1"),
        "stream_drop_repeats": "SELECT event_id, ts, value FROM events",
        "stream_ingest": """
            SELECT CASE WHEN label > 1 THEN vec_id || '.png' END AS id,
                   'images/' || vec_id || '.png' AS origin,
                   CASE WHEN label > 1 THEN strftime(make_timestamp((1700000000 + vec_id) * 1000000), '%Y-%m-%d %H:%M:%S.%f') END AS preprocess_time,
                   CASE WHEN label > 1 THEN round(list_sum(embedding::DOUBLE[]), 5) END AS total,
                   CASE WHEN label > 1 THEN 'ok' WHEN label = 1 THEN 'tensors of 63 values, expected 64' ELSE 'missing tensors' END AS reason
            FROM embeddings""",
        "stream_search": _text_search(2, "lpad(id::VARCHAR, 12, '0')", ", 'docs/' || id AS image_path"),
    }
