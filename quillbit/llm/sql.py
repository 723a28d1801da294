"""DuckDB SQL with the rows of the queries that SQL can express."""

from quillbit.llm.mixing import BUDGET, DIMENSIONS, ROUNDS, TEMPER

CONTROL_COUNT = r"len(regexp_extract_all(text, '\\|\[/?INST\]|\[ASSISTANT\]|\[ROLE:|\[/ROLE\]|\[\+\]|<s>|</s>'))"

CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), ranked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows
), sized AS (
  SELECT *, length(text) + {CONTROL_COUNT} AS body,
    CASE WHEN before IS NULL OR before <> role THEN
      3 + CASE role WHEN 'user' THEN 6 + 7 WHEN 'assistant' THEN 11 + 4
          ELSE 7 + length(role) + len(regexp_extract_all(role, '[\\\]]')) + 7 END
    ELSE 3 END AS marks
  FROM ranked
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(body + marks)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM_WORDS}') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM_WORDS}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, g)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
), again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM win WHERE g IN (SELECT g FROM again)
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.p = words.p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def mixing(rounds: int = ROUNDS, temper: float = TEMPER, budget: float = BUDGET) -> str:
    """Raking unrolled: one step for each marginal and round."""
    steps = [
        r"""rows AS (
  SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang,
    CASE WHEN len(regexp_extract_all(coalesce(text, ''), '[0-9]')) * 50 > length(coalesce(text, '')) THEN 'numeric'
         WHEN len(regexp_extract_all(coalesce(text, ''), '[#$%&*<>|]')) * 50 > length(coalesce(text, '')) THEN 'marked' ELSE 'plain' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL)",
        "w0 AS (SELECT *, 1.0::DOUBLE AS weight, sum(tokens) OVER () AS total FROM cells)",
    ]
    for d in DIMENSIONS:
        steps.append(
            f"s_{d} AS (SELECT {d}, pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {temper}) AS raw FROM cells GROUP BY {d})"
        )
        steps.append(f"t_{d} AS (SELECT {d}, raw / (SELECT sum(raw) FROM s_{d}) AS target FROM s_{d})")
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            steps.append(
                f"w{n + 1} AS MATERIALIZED (SELECT w.* REPLACE (coalesce(w.weight * t.target * w.total / nullif(sum(w.weight * w.tokens) OVER (PARTITION BY w.{d}), 0), w.weight) AS weight) "
                f"FROM w{n} w JOIN t_{d} t USING ({d}))"
            )
            n += 1
    order = f"ORDER BY weight DESC, {', '.join(DIMENSIONS)}"
    steps.append(
        f"filled AS (SELECT *, coalesce(sum(tokens) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, "
        f"sum(weight * tokens) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w{n})"
    )
    steps.append(f"factors AS (SELECT *, ({budget} * total - spent) / nullif(rest, 0) AS c FROM filled)")
    steps.append(f"picked AS (SELECT first(c {order}) AS factor FROM factors WHERE c * weight <= 1)")
    steps.append(
        "plan AS (SELECT source, lang, topic, weight, CASE WHEN tokens = 0 THEN 1.0 ELSE least(1.0, coalesce((SELECT factor FROM picked) * weight, 1.0)) END AS prob FROM factors)"
    )
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(prob, 6) AS prob, "
        "CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '?')), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0 < prob AS sampled "
        "FROM rows JOIN plan USING (source, lang, topic)"
    )


ORACLE = {
    "op4_chat_format": CHAT,
    "op5_decontaminate": DECONTAMINATE,
    "op7_top_k": TOP_K,
    "op9_mix_sources": mixing(),
    "op10_substring_dedup": SUBSTRING,
}
