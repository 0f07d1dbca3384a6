"""SQL (DuckDB) for the rows of the queries of the same names."""

from __future__ import annotations

_STREAM = "s AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)"
_LATENT = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
_SYSTEM = "<system>"


def _sq(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _minus(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: p[1] - p[2])"


def _nearest(name: str, source: str, vector: str, low: int, high: int) -> str:
    """CTE: vec_id, code, c (the centroid), d2, x (the vector)."""
    return (
        f"{name} AS MATERIALIZED (SELECT * FROM (SELECT q.vec_id, b.vec_id AS code, b.e AS c, q.{vector} AS x, {_sq('q.' + vector, 'b.e')} AS d2, "
        f"row_number() OVER (PARTITION BY q.vec_id ORDER BY {_sq('q.' + vector, 'b.e')}, b.vec_id) AS n "
        f"FROM {source} q, v b WHERE b.vec_id >= {low} AND b.vec_id < {high}) WHERE n = 1)"
    )


_RVQ = ", ".join(
    [
        _LATENT,
        _nearest("l0", "v", "e", 0, 32),
        f"r0 AS MATERIALIZED (SELECT vec_id, code AS c0, c AS m0, {_minus('x', 'c')} AS r FROM l0)",
        _nearest("l1", "r0", "r", 32, 64),
        f"r1 AS MATERIALIZED (SELECT vec_id, code AS c1, c AS m1, {_minus('x', 'c')} AS r FROM l1)",
        _nearest("l2", "r1", "r", 64, 96),
        f"r2 AS MATERIALIZED (SELECT vec_id, code AS c2, c AS m2, {_minus('x', 'c')} AS r FROM l2)",
    ]
)
_U = "((CAST('0x' || substr(md5(CAST(code AS VARCHAR)), 1, 8) AS BIGINT) + 1) / 4294967297.0)"


def _probs(temperature: float = 1.0) -> str:
    return (
        f"z AS (SELECT user_id, event_id AS code, value / 100 / {temperature} AS z FROM events), "
        "m AS (SELECT *, exp(z - max(z) OVER (PARTITION BY user_id)) AS x FROM z), "
        "p AS (SELECT user_id, code, x / sum(x) OVER (PARTITION BY user_id) AS p FROM m)"
    )


def _race(source: str) -> str:
    return (
        f"SELECT user_id, code AS token FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p / -ln({_U}) DESC, code) AS n FROM {source}) WHERE n = 1"
    )


_TOP_P = "b AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, code ROWS UNBOUNDED PRECEDING) - p AS before FROM p), t AS (SELECT user_id, code, p / sum(p) OVER (PARTITION BY user_id) AS p FROM b WHERE before <= 0.5)"

_KINDS = "['handshake', 'audio', 'text', 'control', 'metadata', 'error', 'ping']"
_ACTIONS = "['start', 'endTurn', 'pause', 'restart']"
_MESSAGES = f"""m AS (
    SELECT conv_id, turn, {_KINDS}[turn % 7 + 1] AS type, {_ACTIONS}[conv_id % 4 + 1] AS action, conv_id % 4 AS act, text FROM conversations
)"""


def _tap(value: str, offset: int) -> str:
    f, n = ("lead", offset) if offset >= 0 else ("lag", -offset)
    return f"{f}({value}, {n}, 0.0) OVER w"


ORACLES: dict[str, str] = {
    "vq_encode": f"WITH {_LATENT}, {_nearest('l', 'v', 'e', 0, 64)} SELECT vec_id, code, round(sqrt(d2), 6) AS distance FROM l",
    "code_histogram": f"WITH {_LATENT}, {_nearest('l', 'v', 'e', 0, 64)} SELECT code, count(*) AS n, round(avg(sqrt(d2)), 6) AS mean_distance FROM l GROUP BY code",
    "rvq_encode": f"WITH {_RVQ} SELECT vec_id, c0, c1, c2, round(sqrt(list_sum(list_transform(r, lambda x: x * x))), 6) AS error FROM r0 JOIN (SELECT vec_id, c1 FROM r1) USING (vec_id) JOIN (SELECT vec_id, c2, r AS rr FROM r2) USING (vec_id)".replace("list_transform(r, ", "list_transform(rr, "),
    "rvq_decode": f"""WITH {_RVQ} SELECT vec_id, round(sqrt(list_sum(list_transform(r2.r, lambda x: x * x))), 6) AS error, round(m0[1] + m1[1] + m2[1], 6) AS d0
        FROM r0 JOIN r1 USING (vec_id) JOIN r2 USING (vec_id)""",
    "rvq_decode_two_levels": f"WITH {_RVQ} SELECT vec_id, round(sqrt(list_sum(list_transform(r, lambda x: x * x))), 6) AS error FROM r1",
    "rvq_lookup": f"""WITH {_RVQ} SELECT vec_id, round(m0[1] + m1[1] + m2[1], 6) + 0.0 AS d0, round(m0[64] + m1[64] + m2[64], 6) + 0.0 AS d63
        FROM r0 JOIN r1 USING (vec_id) JOIN r2 USING (vec_id)""",
    "split_decode": ", ".join(
        [
            f"WITH {_LATENT}",
            _nearest("s0", "v", "e", 0, 32),
            _nearest("a0", "v", "e", 32, 64),
            f"q0 AS (SELECT vec_id, {_minus('x', 'c')} AS r FROM a0)",
            _nearest("a1", "q0", "r", 64, 96),
            "t AS (SELECT vec_id, s0.c AS s, list_transform(list_zip(a0.c, a1.c), lambda p: p[1] + p[2]) AS a FROM s0 JOIN a0 USING (vec_id) JOIN a1 USING (vec_id))",
        ]
    )
    + """ SELECT vec_id, round(sqrt(list_sum(list_transform(s, lambda x: x * x))), 6) AS semantic,
        round(sqrt(list_sum(list_transform(a, lambda x: x * x))), 6) AS acoustic,
        round(sqrt(list_sum(list_transform(list_zip(s, a), lambda p: (p[1] + p[2]) * (p[1] + p[2])))), 6) AS decoded FROM t""",
    "split_rvq": ", ".join(
        [
            f"WITH {_LATENT}",
            _nearest("s0", "v", "e", 0, 32),
            _nearest("a0", "v", "e", 32, 64),
            f"q0 AS (SELECT vec_id, {_minus('x', 'c')} AS r FROM a0)",
            _nearest("a1", "q0", "r", 64, 96),
        ]
    )
    + " SELECT vec_id, concat_ws(',', s0.code, a0.code, a1.code) AS codes FROM s0 JOIN a0 USING (vec_id) JOIN a1 USING (vec_id)",
    "code_usage_entropy": """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
        p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
        SELECT user_id, count(*) AS n_codes, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM p GROUP BY user_id""",
    "centroids": f"""WITH {_LATENT}, x AS (SELECT label, unnest(e) AS x, unnest(range(64)) AS i FROM v),
        m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i)
        SELECT CAST(label AS BIGINT) AS label, (SELECT count(*) FROM v WHERE v.label = m.label) AS usage, round(sqrt(sum(m * m)), 6) AS norm,
               round(max(m) FILTER (i = 0), 6) + 0.0 AS c0 FROM m GROUP BY label""",
    "codebook_ema": "SELECT CAST(label AS BIGINT) AS label, round(CAST(10.0 * 0.99 AS DOUBLE) + count(*) * CAST(0.01 AS DOUBLE), 6) AS usage FROM embeddings GROUP BY label",
    "expired_codes": f"""WITH {_LATENT}, {_nearest('l', 'v', 'e', 0, 64)}, u AS (SELECT code, count(*) AS n FROM l GROUP BY code)
        SELECT b.vec_id AS code, round(CASE WHEN coalesce(n, 0) < 6 AND f.vec_id IS NOT NULL THEN f.e[1] ELSE b.e[1] END, 6) + 0.0 AS c0
        FROM v b LEFT JOIN u ON u.code = b.vec_id LEFT JOIN v f ON f.vec_id = b.vec_id + 100 WHERE b.vec_id < 64""",
    "bandwidth": f"""WITH {_RVQ}, c AS (SELECT 0 AS level, c0 AS code FROM r0 UNION ALL SELECT 1, c1 FROM r1 UNION ALL SELECT 2, c2 FROM r2)
        SELECT CAST(level AS BIGINT) AS level, count(DISTINCT code) AS n_used, round((level + 1) * log2(2048) * 12.5 / 1000, 6) AS kbps FROM c GROUP BY level""",
    "merge_metrics": """WITH a AS (SELECT event_type AS metric, avg(value) AS x FROM events WHERE user_id % 2 = 0 AND event_type <> 'view' GROUP BY 1),
        b AS (SELECT event_type AS metric, avg(value) AS y FROM events WHERE user_id % 2 = 1 AND event_type <> 'click' GROUP BY 1)
        SELECT metric, round(coalesce((x + 7 * y) / 8, x, y), 6) AS value FROM a FULL JOIN b USING (metric)""",
    "projection": f"WITH {_LATENT} SELECT vec_id, round(0.5 * e[1] + 0.25 * e[2] - e[3] + 2 * e[4], 6) + 0.0 AS p0, round(e[1] - 0.5 * e[2] + 0.125 * e[3], 6) + 0.0 AS p1 FROM v",
    "frame_text": """WITH d AS (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 400.0) AS BIGINT))) AS frame_idx FROM documents)
        SELECT doc_id, frame_idx, md5(rpad(substring(text, frame_idx * 400 + 1, 400), 400, ' ')) AS frame_md5,
               length(substring(text, frame_idx * 400 + 1, 400)) AS n_valid FROM d""",
    "frame_samples": f"""WITH {_LATENT} SELECT vec_id, i AS frame_idx, CAST(24 AS BIGINT) AS n, round(list_sum(e[i * 24 + 1 : i * 24 + 24]), 6) + 0.0 AS total
        FROM v, (SELECT unnest(range(3)) AS i)""",
    "rechunk": """WITH p AS (SELECT conv_id, turn, length(text) AS len, row_number() OVER w - 1 AS no, sum(length(text)) OVER w AS stop,
            floor(sum(length(text)) OVER (PARTITION BY conv_id) / 160) AS frames FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        c AS (SELECT conv_id, no, unnest(range(CAST(floor((stop - len) / 160) AS BIGINT), CAST(least(floor((stop - 1) / 160), frames - 1) AS BIGINT) + 1)) AS frame_idx FROM p WHERE len > 0)
        SELECT conv_id, frame_idx, min(no) AS first_packet, max(no) AS last_packet, count(*) AS n_packets FROM c GROUP BY conv_id, frame_idx""",
    "join_frames": f"WITH {_LATENT} SELECT vec_id, CAST(len(e) AS BIGINT) AS n, round(e[64], 6) + 0.0 AS last FROM v",
    "stereo_zip": """WITH t AS (SELECT conv_id, role, CAST(length(text) AS DOUBLE) AS x, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system'),
        a AS (SELECT * FROM t WHERE role = 'assistant'), u AS (SELECT * FROM t WHERE role = 'user')
        SELECT conv_id, i, coalesce(a.x, 0.0) AS "left", coalesce(u.x, 0.0) AS "right" FROM a FULL JOIN u USING (conv_id, i)""",
    "trim_pad": f"WITH {_LATENT} SELECT vec_id, CAST(vec_id % 48 + 40 AS BIGINT) AS n, round(list_sum(e[1 : vec_id % 48 + 40]), 6) + 0.0 AS total FROM v",
    "delay_align": f"WITH {_STREAM} SELECT event_id, lag(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY pos) AS delayed FROM s",
    "undelay_mask": f"""WITH {_STREAM} SELECT event_id, lead(value, 2, -1.0) OVER w AS undelayed, CAST(lead(1, 2, 0) OVER w AS BIGINT) AS valid
        FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)""",
    "channel_delays": f"WITH {_STREAM} SELECT event_id, pos AS step, pos + CASE WHEN event_id % 17 IN (0, 1, 9) THEN 0 ELSE 1 END AS slot FROM s",
    "duplex_align": """WITH t AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS idx FROM conversations)
        SELECT conv_id, idx, u.n AS user_chars, a.n AS agent_chars FROM (SELECT * FROM t WHERE role = 'user') u FULL JOIN (SELECT * FROM t WHERE role = 'assistant') a USING (conv_id, idx)""",
    "stream_add": """WITH t AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos FROM events)
        SELECT user_id, pos, round(a.value + b.value, 6) AS value FROM (SELECT * FROM t WHERE event_type = 'click') a JOIN (SELECT * FROM t WHERE event_type = 'view') b USING (user_id, pos)""",
    "token_overlay": f"""WITH {_STREAM}, t AS (SELECT event_id, pos, CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE pos % 11 END AS token FROM s)
        SELECT event_id, token, CAST(pos > 0 AND event_id % 5 <> 0 AS BIGINT) AS in_loss FROM t""",
    "warm_up": f"WITH {_STREAM}, d AS (SELECT event_id, pos, lag(value, 1, 32000.0) OVER (PARTITION BY user_id ORDER BY pos) AS value FROM s) SELECT * FROM d WHERE pos > 1",
    "initial_tokens": "SELECT k, CAST(CASE WHEN k = 0 THEN 32000 ELSE 2048 END AS BIGINT) AS token, CASE WHEN k = 0 THEN 'text' WHEN k <= 8 THEN 'agent' ELSE 'user' END AS stream FROM (SELECT unnest(range(17)) AS k)",
    "embed_sum": f"""WITH {_STREAM}, {_LATENT}, t AS (SELECT user_id, pos, k, (pos * 7 + k * 3 + user_id) % 19 - 2 AS token FROM s, (SELECT unnest(range(4)) AS k)),
        j AS (SELECT t.*, CASE WHEN token = -1 THEN 0.0 ELSE e[1] END AS a, CASE WHEN token = -1 THEN 0.0 ELSE e[4] END AS b FROM t JOIN v ON v.vec_id = k * 17 + greatest(token, 0))
        SELECT user_id, pos, round(sum(a), 6) + 0.0 AS e0, round(sum(b), 6) + 0.0 AS e3 FROM j GROUP BY user_id, pos""",
    "causal_conv1d": f"""WITH {_STREAM}, c AS (SELECT user_id, pos, 0.25 * {_tap('value', -1)} + 0.5 * value - {_tap('value', 1)} AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos))
        SELECT user_id, pos // 2 AS frame, round(y, 6) + 0.0 AS y FROM c WHERE pos % 2 = 0""",
    "dilated_conv1d": f"SELECT user_id, pos AS frame, round(y, 6) + 0.0 AS y FROM (WITH {_STREAM} SELECT user_id, pos, 1.0 + {_tap('value', -4)} - 0.5 * {_tap('value', -2)} + 0.25 * value AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos))",
    "streaming_conv1d": f"""WITH {_STREAM}, c AS (SELECT user_id, pos, 0.5 * value + 0.25 * lead(value, 1) OVER w + 0.125 * lead(value, 2) OVER w + lead(value, 3) OVER w AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos))
        SELECT user_id, pos // 3 AS frame, round(y, 6) AS y FROM c WHERE pos % 3 = 0 AND y IS NOT NULL""",
    "conv_transpose": f"""WITH {_STREAM}, x AS (SELECT user_id, pos * 2 + i AS t, value * [1.0, 0.5, 0.25][i + 1] AS y, max(pos) OVER (PARTITION BY user_id) * 2 + 2 AS stop FROM s, (SELECT unnest(range(3)) AS i))
        SELECT user_id, t, round(sum(y), 6) AS y FROM x WHERE t < stop GROUP BY user_id, t""",
    "downsample": f"""WITH {_STREAM}, c AS (SELECT user_id, pos, 0.25 * ({_tap('value', -2)} + {_tap('value', -1)} + value + {_tap('value', 1)}) AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos))
        SELECT user_id, pos // 2 AS frame, round(y, 6) AS y FROM c WHERE pos % 2 = 0""",
    "upsample": f"WITH {_STREAM}, x AS (SELECT user_id, pos * 2 + i AS t, value FROM s, (SELECT unnest(range(4)) AS i)) SELECT user_id, t, round(avg(value), 6) AS y FROM x GROUP BY user_id, t",
    "interpolate": f"""WITH {_STREAM}, n AS (SELECT user_id, pos, value, lead(value, 1, value) OVER (PARTITION BY user_id ORDER BY pos) AS nx FROM s)
        SELECT user_id, pos * 4 + i AS t, round(value + (nx - value) * i / 4, 6) AS y FROM n, (SELECT unnest(range(4)) AS i)""",
    "ring_context_mean": f"WITH {_STREAM} SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS 6 PRECEDING)",
    "ring_context_strict": f"WITH {_STREAM} SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS 5 PRECEDING)",
    "attention_pool": f"""WITH {_STREAM}, j AS (SELECT a.user_id, a.pos, exp(a.value / 100 * b.value / 100 * 0.25 - max(a.value / 100 * b.value / 100 * 0.25) OVER (PARTITION BY a.event_id)) AS w, b.value
            FROM s a JOIN s b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 7 AND a.pos)
        SELECT user_id, pos, round(sum(w * value) / sum(w), 6) AS pooled FROM j GROUP BY user_id, pos""",
    "step_weights": f"WITH {_STREAM} SELECT event_id, round(value * CASE pos WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END, 6) AS y FROM s",
    "pad_modes": f"""WITH {_LATENT}, a AS (SELECT vec_id, list_sum(e[1:5]) AS t, e FROM v)
        SELECT vec_id, round(t, 6) + 0.0 AS zero, round(t + 2 * e[1] + 3 * e[5], 6) + 0.0 AS edge, round(t + e[2] + e[3] + e[4] + e[3] + e[2], 6) + 0.0 AS mirror,
               round(e[2] + e[3] + e[4], 6) + 0.0 AS inner, CAST((ceil((vec_id - 4) / 3.0 + 1) - 1) * 3 + 4 - vec_id AS BIGINT) AS extra FROM a""",
    "fades": f"""WITH {_LATENT}, x AS (SELECT vec_id, unnest(e) AS x, unnest(range(64)) AS i FROM v)
        SELECT vec_id, round(sum(x * i / 64), 6) + 0.0 AS fade_in, round(sum(x * (64 - i) / 64), 6) + 0.0 AS fade_out FROM x GROUP BY vec_id""",
    "rope": f"""WITH {_LATENT}, a AS (SELECT vec_id, e, vec_id * 1.0 AS a0, vec_id * exp(3 * -ln(10000.0) * 2 / 8) AS a3 FROM v)
        SELECT vec_id, round(e[1] * cos(a0) - e[2] * sin(a0), 6) + 0.0 AS r0, round(e[1] * sin(a0) + e[2] * cos(a0), 6) + 0.0 AS r1,
               round(e[7] * cos(a3) - e[8] * sin(a3), 6) + 0.0 AS r6, round(e[7] * sin(a3) + e[8] * cos(a3), 6) + 0.0 AS r7 FROM a""",
    "sin_embedding": f"""WITH {_STREAM} SELECT event_id, round(cos(pos), 6) + 0.0 AS e0, round(cos(pos / pow(10000.0, 1 / 3.0)), 6) + 0.0 AS e1,
        round(sin(pos), 6) + 0.0 AS e4, round(sin(pos / 10000.0), 6) + 0.0 AS e7 FROM s""",
    "conv_encoder": f"""WITH {_STREAM}, a AS (SELECT user_id, pos, 0.25 * lag(value, 2, 0.0) OVER w + 0.5 * lag(value, 1, 0.0) OVER w - 0.25 * value + 0.125 * lead(value, 1, 0.0) OVER w AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
        b AS (SELECT user_id, pos // 2 AS pos, CASE WHEN y > 0 THEN y / 497 ELSE exp(y / 497) - 1 END AS y FROM a WHERE pos % 2 = 0),
        c AS (SELECT user_id, pos, 0.5 * lag(y, 2, 0.0) OVER w + 0.25 * lag(y, 1, 0.0) OVER w + 0.125 * y - 0.5 * lead(y, 1, 0.0) OVER w AS y FROM b WINDOW w AS (PARTITION BY user_id ORDER BY pos))
        SELECT user_id, pos // 2 AS pos, round(y, 6) + 0.0 AS y FROM c WHERE pos % 2 = 0""",
    "conv_decoder": f"""WITH {_STREAM}, x AS (SELECT user_id, pos * 2 + i AS pos, value / 497 * [1.0, 0.5, 0.25, 0.125][i + 1] AS y, max(pos) OVER (PARTITION BY user_id) * 2 + 2 AS stop FROM s, (SELECT unnest(range(4)) AS i))
        SELECT user_id, pos, round(sum(y), 6) + 0.0 AS y FROM x WHERE pos < stop GROUP BY user_id, pos""",
    "rotary_attention": f"""WITH {_STREAM}, x AS (SELECT user_id, pos, value / 100 AS a, CAST(event_id % 3 AS DOUBLE) AS b FROM s),
        j AS (SELECT q.user_id, q.pos, q.a AS qa, q.b AS qb, k.a, k.b, ((q.a * k.a + q.b * k.b) * cos(k.pos - q.pos) + (q.b * k.a - q.a * k.b) * sin(k.pos - q.pos)) / sqrt(2) AS z
            FROM x q JOIN x k ON q.user_id = k.user_id AND k.pos BETWEEN q.pos - 7 AND q.pos),
        e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY user_id, pos)) AS w FROM j)
        SELECT user_id, pos, round(max(qa) + 0.5 * sum(w * a) / sum(w), 6) + 0.0 AS y0, round(max(qb) + 0.5 * sum(w * b) / sum(w), 6) + 0.0 AS y1 FROM e GROUP BY user_id, pos""",
    "rms_norm": f"""WITH {_LATENT}, a AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x)) / 64 + 1e-8) AS n FROM v)
        SELECT vec_id, round(e[1] / n, 6) + 0.0 AS x0, round(e[64] / n, 6) + 0.0 AS x63 FROM a""",
    "layer_norm": f"""WITH {_LATENT}, a AS (SELECT vec_id, e, list_sum(e) / 64 AS m FROM v), b AS (SELECT *, list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / 64 AS s FROM a)
        SELECT vec_id, round((e[1] - m) / sqrt(s + 1e-5), 6) + 0.0 AS x0, round((e[64] - m) / sqrt(s + 1e-5), 6) + 0.0 AS x63 FROM b""",
    "activations": """WITH a AS (SELECT event_id, (value - 250) / 100 AS x FROM events), b AS (SELECT *, 1 / (1 + exp(-x)) AS sg, ln(1 + exp(x)) AS sp FROM a)
        SELECT event_id, round(x, 6) + 0.0 AS identity, round(sg, 6) AS sigmoid, round(tanh(x), 6) + 0.0 AS tanh, round(greatest(x, 0), 6) + 0.0 AS relu,
               round(CASE WHEN x > 0 THEN x ELSE 0.01 * x END, 6) + 0.0 AS leaky_relu, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) + 0.0 AS elu,
               round(x * sg, 6) + 0.0 AS silu, round(x * tanh(sp), 6) + 0.0 AS mish, round(x / (1 + abs(x)), 6) + 0.0 AS softsign FROM b""",
    "gating": f"""WITH {_LATENT}, x AS (SELECT vec_id, unnest(e[1:32]) AS a, unnest(e[33:64]) AS b, unnest(range(1, 33)) AS i FROM v)
        SELECT vec_id, round(sum(a / (1 + exp(-a)) * b * i / 32.0), 6) + 0.0 AS gated FROM x GROUP BY vec_id""",
    "softmax_temp": f"WITH {_probs(0.7)} SELECT user_id, code, round(p, 9) AS p FROM p",
    "greedy_decode": "SELECT user_id, event_id AS token FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value / 100 DESC, event_id) AS n FROM events) WHERE n = 1",
    "topk_mask": f"WITH {_probs()} SELECT * FROM (SELECT user_id, code, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, code) AS rank FROM p) WHERE rank <= 5",
    "topk_sample": f"WITH {_probs(0.8)}, t AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, code) AS r FROM p) WHERE r <= 5) {_race('t')}",
    "topp_mask": f"WITH {_probs()}, {_TOP_P} SELECT user_id, code, round(p, 9) AS p FROM t",
    "topp_sample": f"WITH {_probs()}, {_TOP_P} {_race('t')}",
    "multinomial_sample": f"WITH {_probs()} {_race('p')}",
    "sample_vectors": "SELECT vec_id FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 20",
    "forced_rank_loss": f"""WITH {_probs()}, f AS (SELECT user_id, max(event_id) + CASE WHEN user_id % 5 = 0 THEN 1000000000 ELSE 0 END AS forced FROM events GROUP BY user_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, code) - 1 AS rank FROM p)
        SELECT f.user_id, forced, b.code AS model_token, coalesce(r.rank, -1) AS rank, round(-ln(r.p), 6) + 0.0 AS cross_entropy
        FROM f LEFT JOIN r ON r.user_id = f.user_id AND r.code = forced JOIN r b ON b.user_id = f.user_id AND b.rank = 0""",
    "ordered_codebook_draws": f"""WITH RECURSIVE {_STREAM}, f AS (
            SELECT user_id, pos, CASE WHEN event_id % 3 = 0 THEN event_id % 97 ELSE event_id % 97 END AS token FROM s WHERE pos % 4 = 0
            UNION ALL SELECT s.user_id, s.pos, CASE WHEN event_id % 3 = 0 THEN event_id % 97 ELSE (token * 31 + event_id) % 97 END FROM f JOIN s ON s.user_id = f.user_id AND s.pos = f.pos + 1 AND s.pos % 4 <> 0),
        l AS (SELECT user_id, pos // 4 AS step, token, row_number() OVER (PARTITION BY user_id, pos // 4 ORDER BY pos DESC) AS n FROM f)
        SELECT user_id, step, token AS last_token FROM l WHERE n = 1""",
    "latency_ema": f"""WITH {_STREAM} SELECT event_id, round(sum(0.15 * value * pow(0.85, -pos)) OVER w / sum(0.15 * pow(0.85, -pos)) OVER w, 6) AS ema
        FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    "rms_intensity": "SELECT user_id, round(sqrt(avg(value * value)), 6) AS rms, CAST(floor(least(greatest(sqrt(avg(value * value)) / 500, 0), 1) * 10) AS BIGINT) AS level FROM events GROUP BY user_id",
    "loudness_gain": """WITH l AS (SELECT user_id, 10 * log10(avg((value / 1000) * (value / 1000))) - 0.691 AS level FROM events GROUP BY user_id)
        SELECT user_id, round(level, 6) AS level, round(pow(10.0, (-24.0 - level) / 20), 6) AS gain FROM l""",
    "jitter_playback": """WITH RECURSIVE e AS MATERIALIZED (
            SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
                   CASE WHEN event_type <> 'view' THEN CAST(trunc(value * 8) AS BIGINT) ELSE 0 END AS s FROM events
        ), b AS (
            SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS held, 0 AS started, 0::BIGINT AS wait_left, 240::BIGINT AS wait, 240::BIGINT AS slack,
                   0::BIGINT AS total, 0::BIGINT AS actual, 0::BIGINT AS dropped, -1::BIGINT AS lo, 0::BIGINT AS hi FROM e
            UNION ALL
            SELECT user_id, i, held - given, CASE WHEN dry THEN 0 ELSE started END, CASE WHEN plays THEN wait_left ELSE wait_left - 1920 END,
                   CASE WHEN dry THEN least(wait + 120, 1920) ELSE wait END, slack, CASE WHEN plays OR actual > 0 THEN total + 1920 ELSE total END,
                   actual + given, dropped, CASE WHEN NOT plays THEN lo WHEN lo < 0 THEN held ELSE least(lo, held) END,
                   CASE WHEN plays THEN greatest(hi, held) ELSE hi END
            FROM (SELECT *, CASE WHEN plays THEN least(held, 1920) ELSE 0 END AS given, plays AND held < 1920 AS dry FROM (
                SELECT user_id, i, held - lost AS held, started, wait_left, wait, CASE WHEN lost > 0 THEN least(slack + 120, 1920) ELSE slack END AS slack,
                       total, actual, dropped + lost AS dropped, lo, hi, started = 1 AND held > lost AND wait_left <= 0 AS plays
                FROM (SELECT *, CASE WHEN s > 0 AND held >= 1920 + wait + slack THEN held - 1920 - wait ELSE 0 END AS lost FROM (
                    SELECT user_id, i, s, held, CASE WHEN begins THEN 1 ELSE started END AS started, CASE WHEN begins THEN wait ELSE wait_left END AS wait_left,
                           wait, slack, total, actual, dropped, lo, hi
                    FROM (SELECT b.user_id, e.i, e.s, b.held + e.s AS held, e.s > 0 AND b.held + e.s >= 1920 AND b.started = 0 AS begins,
                                 started, wait_left, wait, slack, total, actual, dropped, lo, hi FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)))))
        )
        SELECT user_id, total, actual, total - actual AS missed, dropped, lo AS min_delay, hi AS max_delay FROM b
        WHERE (user_id, i) IN (SELECT user_id, max(i) FROM e GROUP BY user_id)""",
    "inactivity_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM n GROUP BY user_id, no""",
    "playback_clock": """WITH t AS (SELECT user_id, round(sum(value) / 10, 4) AS t FROM events GROUP BY user_id)
        SELECT user_id, CAST(CAST(floor(t / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(t) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(CAST(floor(100 * (t - floor(t))) AS BIGINT) AS VARCHAR), 2, '0') AS clock FROM t""",
    "system_prompt_wrap": f"""WITH t AS (SELECT conv_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE role = 'system')
        SELECT conv_id, CASE WHEN t LIKE '{_SYSTEM}%' AND t LIKE '%{_SYSTEM}' THEN t ELSE '{_SYSTEM} ' || t || ' {_SYSTEM}' END AS prompt FROM t""",
    "prompt_program": f"""WITH s AS (SELECT conv_id, string_split('{_SYSTEM} ' || trim(text) || ' {_SYSTEM}', ' ') AS w FROM conversations WHERE role = 'system'),
        p AS (SELECT conv_id, 0 AS phase, unnest(['v430', 'v1268', 'v381', 'v1611', 'v1095', 'v1495', 'v56', 'v472']) AS token, unnest(range(8)) AS i FROM s
            UNION ALL SELECT conv_id, 1, 'silence', unnest(range(6)) FROM s UNION ALL SELECT conv_id, 2, unnest(w), unnest(range(len(w))) FROM s
            UNION ALL SELECT conv_id, 3, 'silence', unnest(range(6)) FROM s)
        SELECT conv_id, CAST(phase AS BIGINT) AS phase, row_number() OVER (PARTITION BY conv_id ORDER BY phase, i) - 1 AS step, token FROM p""",
    "message_codec": f"""WITH {_MESSAGES}, b AS (SELECT conv_id, turn, type,
            CASE type WHEN 'handshake' THEN '' WHEN 'audio' THEN hex(encode(text)) WHEN 'control' THEN action WHEN 'ping' THEN '' ELSE text END AS data,
            CASE type WHEN 'handshake' THEN unhex('000000') WHEN 'control' THEN unhex('030' || act) WHEN 'ping' THEN unhex('06')
                 ELSE unhex('0' || (turn % 7)) || encode(text) END AS message FROM m)
        SELECT conv_id, turn, type, md5(data) AS data_md5, md5(message) AS message_md5 FROM b""",
    "message_rejects": "SELECT CASE WHEN turn = 0 THEN 'empty message' ELSE 'unknown kind' END AS error, count(*) AS n FROM conversations GROUP BY 1",
    "message_counters": f"""WITH {_MESSAGES} SELECT conv_id, count(*) FILTER (type = 'audio') AS n_audio, count(*) FILTER (type = 'text') AS n_text, count(*) FILTER (type = 'control') AS n_control,
        count(*) FILTER (type = 'metadata') AS n_metadata, count(*) FILTER (type = 'error') AS n_error, count(*) FILTER (type = 'ping') AS n_ping FROM m GROUP BY conv_id""",
    "json_check": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
    "transcript_live": f"""WITH {_STREAM} SELECT user_id, string_agg(' ' || event_type, '' ORDER BY pos) AS text, arg_max(' ' || event_type, pos) AS current FROM s WHERE event_id % 5 NOT IN (0, 3) GROUP BY user_id""",
    "transcript_offline": f"""WITH {_STREAM}, t AS (SELECT user_id, pos, CASE event_id % 5 WHEN 0 THEN 'EPAD' WHEN 3 THEN 'PAD' ELSE ' ' || event_type END AS x FROM s)
        SELECT user_id, '["' || string_agg(x, '","' ORDER BY pos) || '"]' AS value FROM t GROUP BY user_id""",
    "session_links": """SELECT conv_id, 'wss://host/api/chat?text_topk=25&session=' || conv_id || '&text_prompt=' || replace(url_encode(substring(text, 1, 12)), '%20', '+') AS url
        FROM conversations WHERE turn = 0""",
    "session_urls": """SELECT conv_id, 'wss://host/api/chat?text_temperature=0.7&text_topk=25&audio_temperature=0.8&audio_topk=250&pad_mult=0&text_seed='
            || (conv_id % 1000001) || '&audio_seed=' || (conv_id * 7 % 1000001) || '&repetition_penalty_context=64&repetition_penalty=1&text_prompt='
            || replace(replace(replace(url_encode(coalesce(text, '')), '%20', '+'), '%2A', '*'), '~', '%7E') || '&voice_prompt=NATF0.pt' AS url
        FROM conversations WHERE turn = 0""",
    "label_checks": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NATURAL_F' ELSE 'VARIETY_M' END || (c_custkey % 4) AS label,
        CAST(c_custkey % 3 <> 0 AS BIGINT) AS is_email FROM customer""",
    "weight_patch": """WITH h AS (SELECT * FROM nation WHERE n_nationkey < 8 OR n_nationkey = 20)
        SELECT CAST(n.n_nationkey AS BIGINT) AS key, coalesce(h.n_name, f.n_name) AS value, CASE WHEN h.n_name IS NOT NULL THEN 'own' WHEN f.n_name IS NOT NULL THEN 'copied' ELSE 'missing' END AS source
        FROM nation n LEFT JOIN h USING (n_nationkey) LEFT JOIN h f ON f.n_nationkey = n.n_nationkey - 8 AND n.n_nationkey BETWEEN 8 AND 15""",
    "state_key_audit": """WITH g AS (SELECT DISTINCT s_nationkey + CASE WHEN s_suppkey % 9 = 0 THEN 20 ELSE 0 END AS key FROM supplier), e AS (SELECT n_nationkey AS key FROM nation)
        SELECT CAST(key AS BIGINT) AS key, 'missing' AS problem FROM e ANTI JOIN g USING (key) UNION ALL SELECT CAST(key AS BIGINT), 'left over' FROM g ANTI JOIN e USING (key)""",
    "state_merge": """SELECT CAST(coalesce(n_nationkey, k) AS BIGINT) AS key, coalesce(r_name, n_name) AS value FROM nation FULL JOIN (SELECT r_regionkey * 7 AS k, r_name FROM region) ON k = n_nationkey""",
    "prompt_lookup": """WITH o AS (SELECT o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1000000 ELSE 0 END AS k FROM orders)
        SELECT 'found' AS kind, count(*) AS n FROM o SEMI JOIN customer ON c_custkey = k UNION ALL SELECT 'absent', count(*) FROM o ANTI JOIN customer ON c_custkey = k""",
    "flatten_state": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS nation_name, CAST(n_regionkey AS BIGINT) AS nation_region_key FROM nation",
}
