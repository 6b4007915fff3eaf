"""The derived input tables of ``lilt.fixtures`` as SQL common table expressions for the correctness check."""

from __future__ import annotations

from lilt.functions.tokens import HESITATIONS, NON_ENDERS


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


MARKS = ".,?!:;\"''"


def clean(word: str) -> str:
    return f"rtrim(lower(trim({word})), '{MARKS}')"


def hesitates(word: str, duration: str) -> str:
    return f"({clean(word)} IN ({_quoted(HESITATIONS)}) OR ({clean(word)} = 'a' AND {duration} >= 350))"


def ends(word: str) -> str:
    return f"(right({word}, 1) IN ('.', '?', '!'))"


def lower_head(word: str) -> str:
    return f"(lower(left({word}, 1)) = left({word}, 1) AND upper(left({word}, 1)) <> left({word}, 1))"


def upper_head(word: str) -> str:
    return f"(upper(left({word}, 1)) = left({word}, 1) AND lower(left({word}, 1)) <> left({word}, 1))"


NON_ENDER_LIST = _quoted(NON_ENDERS)

# name -> (tables it needs, body)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "tokens": (
        (),
        r"""SELECT conv_id AS recording_id, turn, unnest(t) AS token, generate_subscripts(t, 1) AS p
        FROM (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS t FROM conversations)""",
    ),
    "words": (
        ("tokens",),
        """SELECT recording_id, word_idx, turn, word, CAST(start_ms AS BIGINT) AS start_ms,
          CAST(start_ms + dur AS BIGINT) AS end_ms, (100 - (word_idx * 7 + recording_id) % 45) / 100.0 AS confidence
        FROM (SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY recording_id ORDER BY word_idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms
          FROM (SELECT *, CASE WHEN word_idx % 58 = 3 THEN 400 ELSE 60 * length(word) + 40 END AS dur,
              40 * ((word_idx * 37 + recording_id * 13) % 11) - 40
              + CASE WHEN right(word, 1) IN ('.', '?', '!') THEN 700 WHEN right(word, 1) = ',' THEN 400 ELSE 0 END
              + CASE WHEN word_idx % 53 = 52 THEN 1100 ELSE 0 END AS gap
            FROM (SELECT recording_id, turn, word_idx,
                CASE WHEN word_idx % 17 = 5 THEN 'um' WHEN word_idx % 29 = 3 THEN 'a' ELSE token END AS word
              FROM (SELECT recording_id, turn, token,
                  row_number() OVER (PARTITION BY recording_id ORDER BY turn, p) - 1 AS word_idx FROM tokens))))""",
    ),
    "recordings": (
        ("words",),
        "SELECT recording_id, max(end_ms) + 200 AS duration_ms, 16000 AS sample_rate FROM words GROUP BY 1",
    ),
    "phrased": (
        ("words",),
        f"""SELECT recording_id, word_idx, word, start_ms, end_ms, confidence, phrase_index, pos, nxt IS NULL AS is_last,
          CAST(greatest(coalesce(nxt - end_ms, 0), 0) AS BIGINT) AS pause_after_ms,
          {hesitates('word', 'end_ms - start_ms')} AS is_hesitation
        FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, phrase_index ORDER BY word_idx) - 1 AS pos,
            lead(start_ms) OVER (PARTITION BY recording_id, phrase_index ORDER BY word_idx) AS nxt
          FROM (SELECT *, CAST(coalesce(sum(CASE WHEN {ends('word')} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id
              ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS phrase_index FROM words))""",
    ),
    "labels_raw": (
        ("phrased",),
        """SELECT recording_id, phrase_index, pos, CASE WHEN word_idx % 41 = 0 THEN '' WHEN word_idx % 7 = 0 THEN 'zz' || word
            WHEN word_idx % 5 = 0 THEN left(word, length(word) - 1) ELSE word END AS word,
          CASE WHEN (length(word) + word_idx) % 4 = 0 THEN 1 ELSE 0 END AS label
        FROM phrased WHERE word_idx % 23 <> 0""",
    ),
    "stressed": (
        ("phrased", "labels_raw"),
        """SELECT w.*, coalesce(CASE WHEN near THEN l1 ELSE l2 END, 0) = 1 AS stressed,
          CASE WHEN coalesce(CASE WHEN near THEN l1 ELSE l2 END, 0) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS stress_score
        FROM (SELECT p.*, l.label AS l1, f.label AS l2, coalesce(starts_with(lower(trim(p.word)), lower(trim(l.word)))
            OR starts_with(lower(trim(l.word)), lower(trim(p.word))), false) AS near
          FROM phrased p LEFT JOIN labels_raw l USING (recording_id, phrase_index, pos)
          LEFT JOIN (SELECT recording_id, phrase_index, lower(trim(word)) AS token, arg_min(label, pos) AS label
            FROM labels_raw GROUP BY ALL) f
            ON f.recording_id = p.recording_id AND f.phrase_index = p.phrase_index AND f.token = lower(trim(p.word))) w""",
    ),
    "absorbed": (
        ("phrased",),
        """SELECT recording_id, arg_min(word_idx, word_idx) AS word_idx, min(phrase_index) AS phrase_index, min(pos) AS pos,
          arg_min(word, word_idx) AS word, min(start_ms) AS start_ms, arg_min(end_ms, word_idx) AS end_ms,
          arg_min(confidence, word_idx) AS confidence, arg_min(is_hesitation, word_idx) AS is_hesitation,
          CAST(sum(pause_after_ms + CASE WHEN word_idx = a THEN 0 ELSE end_ms - start_ms END) AS BIGINT) AS pause_after_ms,
          count(*) - 1 AS absorbed
        FROM (SELECT *, max(CASE WHEN pos = 0 OR NOT is_hesitation THEN word_idx END)
            OVER (PARTITION BY recording_id ORDER BY word_idx) AS a FROM phrased) GROUP BY recording_id, a""",
    ),
    "vocabulary": (
        ("words",),
        f"SELECT {clean('word')} AS token FROM words WHERE {lower_head('word')} GROUP BY 1 HAVING count(*) >= 3",
    ),
    "repaired": (
        ("words", "vocabulary"),
        f"""SELECT recording_id, word_idx, start_ms, end_ms, confidence, false_period,
          CASE WHEN false_period THEN rtrim(w2, '.?!') ELSE w2 END AS word
        FROM (SELECT *, CASE WHEN coalesce(lag(false_period) OVER w, false) AND {upper_head('word')} AND word <> 'I'
              AND NOT starts_with(word, 'I''') AND lc THEN lower(left(word, 1)) || substr(word, 2) ELSE word END AS w2
          FROM (SELECT *, coalesce(nw IS NOT NULL AND {ends('word')} AND ({lower_head('nw')}
                OR {clean('word')} IN ({NON_ENDER_LIST}) OR (ns - end_ms < 800 AND nlc)), false) AS false_period
            FROM (SELECT *, lead(word) OVER w AS nw, lead(start_ms) OVER w AS ns, lead(lc) OVER w AS nlc
              FROM (SELECT words.*, v.token IS NOT NULL AS lc FROM words LEFT JOIN vocabulary v ON v.token = {clean('word')})
              WINDOW w AS (PARTITION BY recording_id ORDER BY word_idx)))
          WINDOW w AS (PARTITION BY recording_id ORDER BY word_idx))""",
    ),
    "breaks": (
        ("repaired",),
        f"""SELECT *, {ends('word')} OR nxt IS NULL OR nxt - end_ms >= 1000 AS hard,
          right(word, 1) IN (',', ';') OR coalesce(nxt - end_ms >= 400, false) AS soft
        FROM (SELECT *, lead(start_ms) OVER (PARTITION BY recording_id ORDER BY word_idx) AS nxt FROM repaired)""",
    ),
    "next_start": (
        ("breaks",),
        """SELECT h.recording_id, h.word_idx AS s, 1 + least(h.nh, coalesce(f.ns, h.nh)) AS n FROM
          (SELECT recording_id, word_idx, min(CASE WHEN hard THEN word_idx END) OVER (PARTITION BY recording_id
            ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nh FROM breaks) h
          LEFT JOIN (SELECT recording_id, word_idx, min(CASE WHEN soft THEN word_idx END) OVER (PARTITION BY recording_id
            ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ns FROM breaks) f
          ON f.recording_id = h.recording_id AND f.word_idx = h.word_idx + 29""",
    ),
    "starts": (
        ("next_start",),
        """SELECT DISTINCT recording_id, 0::BIGINT AS s FROM next_start
          UNION ALL SELECT st.recording_id, n.n FROM starts st JOIN next_start n ON n.recording_id = st.recording_id AND n.s = st.s
          JOIN next_start m ON m.recording_id = n.recording_id AND m.s = n.n""",
    ),
    "sentences": (
        ("breaks", "starts"),
        f"""SELECT recording_id, word_idx, start_ms, end_ms, confidence, phrase_index, pos, is_last,
          CASE WHEN is_last AND w2 <> '' AND NOT {ends('w2')} THEN
            CASE WHEN right(w2, 1) IN (',', ';', ':') THEN rtrim(w2, ',;:') || '.' ELSE w2 || '.' END ELSE w2 END AS word
        FROM (SELECT *, CASE WHEN pos = 0 AND {lower_head('word')} THEN upper(left(word, 1)) || substr(word, 2) ELSE word END AS w2
          FROM (SELECT b.*, q.phrase_index, b.word_idx - q.s AS pos,
              b.word_idx = max(b.word_idx) OVER (PARTITION BY b.recording_id, q.phrase_index) AS is_last
            FROM breaks b ASOF JOIN (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY s) - 1 AS phrase_index
              FROM starts) q ON q.recording_id = b.recording_id AND b.word_idx >= q.s))""",
    ),
    "segments": (
        ("words",),
        """SELECT recording_id, CAST(seg_idx AS BIGINT) AS seg_idx, min(start_ms) * 16 AS start_sample, max(end_ms) * 16 AS end_sample
        FROM (SELECT *, sum(CASE WHEN start_ms - pe >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id
            ORDER BY word_idx) AS seg_idx
          FROM (SELECT *, lag(end_ms) OVER (PARTITION BY recording_id ORDER BY word_idx) AS pe FROM words))
        WHERE recording_id % 25 <> 7 GROUP BY ALL""",
    ),
    "segments_full": (
        ("segments", "recordings"),
        """SELECT * FROM segments UNION ALL SELECT recording_id, 0, 0, duration_ms * sample_rate // 1000 FROM recordings
        WHERE recording_id NOT IN (SELECT recording_id FROM segments)""",
    ),
    "frames": (
        (),
        """SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
          CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE (80 + value) *
            CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 2 ELSE 1 END END AS f0, event_type FROM events""",
    ),
    "frame_words": (
        ("frames",),
        """SELECT recording_id, frame_idx // 8 AS word_idx, event_type || CASE WHEN (frame_idx // 8) % 4 = 3 THEN '.' ELSE '' END
          AS word, frame_idx * 10 AS start_ms, frame_idx * 10 + 60 AS end_ms FROM frames WHERE frame_idx % 8 = 0""",
    ),
    "runs": (
        ("frames",),
        """SELECT *, CASE WHEN f0 IS NOT NULL THEN min(frame_idx) OVER g END AS run_start,
          CASE WHEN f0 IS NOT NULL THEN count(*) OVER g END AS run_len
        FROM (SELECT *, CASE WHEN f0 IS NULL THEN -1 ELSE frame_idx - row_number() OVER (PARTITION BY recording_id, f0 IS NULL
            ORDER BY frame_idx) END AS island FROM frames) WINDOW g AS (PARTITION BY recording_id, f0 IS NULL, island)""",
    ),
    "job_events": (
        (),
        """SELECT o_orderkey AS job_id, e.seq AS seq, o_orderdate + to_seconds(e.sec) AS event_ts, e.w AS write, CASE WHEN e.seq = 0 THEN 'queued'
            WHEN e.seq IN (1, 2) THEN 'processing' WHEN e.seq = 4 THEN CASE WHEN o_orderkey % 50 = 0 THEN 'failed' ELSE 'complete' END
            END AS status,
          CASE WHEN e.seq = 0 THEN 0.0::DOUBLE WHEN e.seq = 3 THEN 0.5::DOUBLE WHEN e.seq = 4 AND o_orderkey % 50 <> 0 THEN 1.0::DOUBLE END AS progress,
          CASE WHEN e.seq = 2 THEN o_orderkey % 7 + 1 END AS total_chunks,
          CASE WHEN e.seq = 3 THEN 1 WHEN e.seq = 4 AND o_orderkey % 50 <> 0 THEN o_orderkey % 7 + 1 END AS completed_chunks,
          CASE WHEN e.seq = 3 THEN 'analyzing' WHEN e.seq = 4 AND o_orderkey % 50 <> 0 THEN 'done' END AS current_stage,
          CASE WHEN e.seq = 0 THEN '{}' WHEN e.seq = 3 THEN CASE WHEN o_orderkey % 5 = 0 THEN '{"word_count": null}' ELSE '{"word_count": 1}' END
            WHEN e.seq = 4 AND o_orderkey % 50 <> 0 THEN CASE WHEN o_orderkey % 97 = 0 THEN '{"word_count": ' WHEN o_orderkey % 89 = 0 THEN
            '{"word_count": "many"}' WHEN o_orderkey % 83 = 0 THEN '{"word_count": "12", "total_duration": "2.5", "phrases": []}'
            WHEN o_orderkey % 79 = 0 THEN '{}' WHEN o_orderkey % 71 = 0 THEN '[1]' ELSE '{"total_duration": ' || (o_orderkey % 600)
            || '.5, "word_count": ' || (o_orderkey % 1000) || CASE WHEN o_orderkey % 3 = 0 THEN ', "phrases": [' || array_to_string([
              '{"phrase_index": ' || k || ', "text": "w' || (o_orderkey % 7) || ' v", "words": [{"word": "w' || (o_orderkey % 7) || '", "start": ' || k
              || '.5, "end": ' || k || '.75, "stressed": true}, {"word": "v", ' || CASE WHEN o_orderkey % 73 = 0 THEN '' ELSE '"start": 1.25, ' END
              || '"end": "1.5", "confidence": 0.5, "extra": [1]}], "start_time": ' || k || '.5, "end_time": 9, "chunk_index": "' || k || '"}'
              FOR k IN [0, 1]], ', ') || ']' ELSE '' END || '}' END END AS result,
          CASE WHEN e.seq = 4 AND o_orderkey % 50 = 0 THEN 'ValueError: bad audio' END AS error
        FROM orders JOIN (VALUES (0, 0, 'create'), (1, 2, 'status'), (2, 9, 'status'), (3, 10, 'progress'), (4, 20, 'status'))
          e(seq, sec, w) ON e.seq = 0 OR (e.seq <= 3 AND o_orderstatus IN ('P', 'F')) OR (e.seq = 4 AND o_orderstatus = 'F')""",
    ),
    "job_state": (
        ("job_events",),
        """SELECT job_id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status,
          arg_max(progress, seq) FILTER (progress IS NOT NULL) AS progress,
          min(event_ts) FILTER (write = 'create') AS created_at, max(event_ts) FILTER (status = 'processing') AS started_at,
          min(event_ts) FILTER (status = 'processing') AS first_started_at,
          max(event_ts) FILTER (status IN ('complete', 'failed')) AS completed_at,
          CAST(coalesce(arg_max(total_chunks, seq) FILTER (total_chunks IS NOT NULL), 0) AS INTEGER) AS total_chunks,
          CAST(coalesce(arg_max(completed_chunks, seq) FILTER (completed_chunks IS NOT NULL), 0) AS INTEGER) AS completed_chunks,
          coalesce(arg_max(current_stage, seq) FILTER (current_stage IS NOT NULL), '') AS current_stage,
          arg_max(result, seq) FILTER (result IS NOT NULL) AS result,
          coalesce(arg_max(error, seq) FILTER (error IS NOT NULL), '') AS error
        FROM job_events GROUP BY job_id""",
    ),
    "chunk_texts": (
        (),
        """SELECT recording_id, seq, CASE WHEN page_id % 11 = 0 AND b IS NOT NULL THEN b ELSE html END AS content
        FROM (SELECT page_id % 20 AS recording_id, page_id, html, row_number() OVER w - 1 AS seq, lag(html) OVER w AS b
          FROM pages WINDOW w AS (PARTITION BY page_id % 20 ORDER BY page_id))""",
    ),
    "gate_checks": (
        ("chunk_texts",),
        """SELECT recording_id, seq, e, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS i FROM (
          SELECT recording_id, seq, sum(60 + (seq * 97 + recording_id * 13) % 640) OVER (PARTITION BY recording_id ORDER BY seq)::BIGINT AS e
          FROM chunk_texts) WHERE seq >= 2 AND seq % 2 = 0""",
    ),
    "gate_walk": (
        ("gate_checks",),
        """SELECT recording_id, 0::BIGINT AS i, 0::BIGINT AS seq, 0::BIGINT AS e, 0::BIGINT AS given FROM gate_checks GROUP BY recording_id
          UNION ALL SELECT w.recording_id, w.i + 1, c.seq, c.e, CASE WHEN c.e - w.given >= 1500 THEN c.e - 400 ELSE w.given END
          FROM gate_walk w JOIN gate_checks c ON c.recording_id = w.recording_id AND c.i = w.i + 1""",
    ),
    "pcm": (
        (),
        """SELECT vec_id % 50 AS recording_id, vec_id // 50 AS block_idx, (vec_id // 50) * 64 AS start_sample,
          embedding AS samples FROM embeddings""",
    ),
    "samples": (
        ("pcm",),
        """SELECT recording_id, start_sample + i - 1 AS n_at, block_idx, CAST(x AS DOUBLE) AS x FROM (SELECT recording_id, block_idx,
          start_sample, unnest(samples) AS x, generate_subscripts(samples, 1) AS i FROM pcm)""",
    ),
    "windows": (
        ("words",),
        """SELECT t.recording_id AS session_id, t.n AS trigger_seq, greatest(0, t.n * 2000 - 8000) AS w0, least(8000, t.n * 2000) AS len,
          coalesce(list({'i': w.word_idx, 'word': w.word, 's': w.start_ms - greatest(0, t.n * 2000 - 8000),
            'e': w.end_ms - greatest(0, t.n * 2000 - 8000), 'c': w.confidence} ORDER BY w.word_idx)
            FILTER (w.word_idx IS NOT NULL), []) AS words
        FROM (SELECT recording_id, unnest(range(1, max(end_ms) // 2000 + 2)) AS n FROM words GROUP BY recording_id) t
        LEFT JOIN words w ON w.recording_id = t.recording_id AND w.end_ms <= t.n * 2000
          AND w.start_ms >= greatest(0, t.n * 2000 - 8000) GROUP BY ALL""",
    ),
    "cursor_walk": (
        ("windows",),
        """SELECT DISTINCT session_id, 0::BIGINT AS n, 0::BIGINT AS cur, NULL::BIGINT AS w0,
            []::STRUCT(i BIGINT, word VARCHAR, s BIGINT, e BIGINT, c DOUBLE)[] AS fresh FROM windows
          UNION ALL SELECT session_id, n, CASE WHEN len(f) > 0 THEN w0 + f[len(f)].e WHEN w0 + wl - cur > 5000
            THEN w0 + wl - 2000 ELSE cur END, w0, f FROM (
            SELECT c.session_id, w.trigger_seq AS n, c.cur, w.w0, w.len AS wl, CASE WHEN w.w0 + w.len - c.cur < 1500 THEN []
              ELSE [x FOR x IN w.words IF x.s >= c.cur - w.w0 AND x.e <= w.len - 400] END AS f
            FROM cursor_walk c JOIN windows w ON w.session_id = c.session_id AND w.trigger_seq = c.n + 1)""",
    ),
}

_RECURSIVE = {"starts", "chunk_walk", "cursor_walk", "gate_walk"}


def sql(body: str, *needs: str) -> str:
    """``body`` with the tables it needs in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in TABLES[name][0]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    parts = [f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({TABLES[n][1]})" for n in order]
    return f"WITH {'RECURSIVE ' if _RECURSIVE & set(order) else ''}" + ",\n".join(parts) + "\n" + body


def split_segments(max_ms: int) -> str:
    longest = max_ms * 16
    return f"""SELECT recording_id, seg_idx, j AS part, s + j * ((e - s) // n) AS start_sample,
      CASE WHEN j = n - 1 THEN e ELSE s + (j + 1) * ((e - s) // n) END AS end_sample
    FROM (SELECT *, unnest(range(0, n)) AS j FROM (SELECT *, greatest(1, (e - s + {longest - 1}) // {longest}) AS n
      FROM (SELECT recording_id, seg_idx, greatest(0, start_sample - 2400) AS s,
          least(duration_ms * 16, end_sample + 2400) AS e FROM segments_full JOIN recordings USING (recording_id))))"""


def chunks(max_ms: int, target_ms: int) -> str:
    """Tables ``pieces`` and ``chunk_walk`` and the chunk rows, to follow a WITH list."""
    target = target_ms * 16
    return f""", pieces AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS i, coalesce(start_sample - lag(end_sample) OVER w >= 19200,
        true) AS hard FROM ({split_segments(max_ms)}) WINDOW w AS (PARTITION BY recording_id ORDER BY start_sample, seg_idx, part)),
    hops AS MATERIALIZED (SELECT a.recording_id, a.i, min(b.i) AS n FROM pieces a LEFT JOIN pieces b ON b.recording_id = a.recording_id
        AND b.i > a.i AND (b.hard OR b.end_sample - a.start_sample > {target}) GROUP BY ALL),
    chunk_walk AS (SELECT DISTINCT recording_id, 0::BIGINT AS i FROM pieces UNION ALL SELECT h.recording_id, h.n FROM chunk_walk c
        JOIN hops h ON h.recording_id = c.recording_id AND h.i = c.i WHERE h.n IS NOT NULL),
    chunk_rows AS MATERIALIZED (SELECT p.recording_id, g.chunk_index, min(p.start_sample) AS start_sample,
        arg_max(p.end_sample, p.i) AS end_sample, count(*) AS n_segments
      FROM pieces p ASOF JOIN (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY i) - 1 AS chunk_index FROM chunk_walk) g
        ON g.recording_id = p.recording_id AND p.i >= g.i GROUP BY ALL)"""


def chunk_sql(body: str, max_ms: int = 29_000, target_ms: int = 25_000) -> str:
    head = sql("", "segments_full", "recordings").rstrip()
    return "WITH RECURSIVE" + head.removeprefix("WITH") + chunks(max_ms, target_ms) + "\n" + body


def pieces_of_runs(max_len: int = 500, min_len: int = 8) -> str:
    """Voiced frames with the start and length of their segment."""
    return f"""SELECT recording_id, frame_idx, f0, run_start + piece * size AS start_frame,
      CASE WHEN piece = n - 1 THEN run_len - piece * size ELSE size END AS segment_len
    FROM (SELECT *, least((frame_idx - run_start) // size, n - 1) AS piece FROM (SELECT *, run_len // n AS size FROM (SELECT *,
      (run_len + {max_len - 1}) // {max_len} AS n FROM runs WHERE run_len >= {min_len})))
    WHERE CASE WHEN piece = n - 1 THEN run_len - piece * size ELSE size END >= {min_len}"""
