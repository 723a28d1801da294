"""DuckDB SQL with the rows of the core queries."""

from __future__ import annotations

from quillbit.functions import symbols as S
from quillbit.plans import experiments, fixtures
from quillbit.plans.spec import CATEGORY_WEIGHTS, RANDOM_BYTES, grid_names

SQL: dict[str, str] = {}

DOCS = "d AS (SELECT doc_id, text, lang, source FROM documents WHERE text <> '')"
CHARS = f"{DOCS}, c AS (SELECT doc_id, lang, unnest(generate_series(0, length(text) - 1)) AS pos, unnest(string_split(text, '')) AS ch FROM d), s AS (SELECT doc_id, lang, pos, unicode(ch) AS sym FROM c)"
BYTES = (
    f"{DOCS}, h AS (SELECT doc_id, lang, hex(encode(text)) AS x FROM d), "
    "g AS (SELECT doc_id, lang, unnest(generate_series(0, length(x) // 2 - 1)) AS pos, unnest(regexp_extract_all(x, '..')) AS b FROM h), "
    "s AS (SELECT doc_id, lang, pos, CAST('0x' || b AS INTEGER) AS sym FROM g)"
)
WORD = r"[^\x20\x09-\x0D]+"
WIDTH = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 2048 THEN 2 WHEN {0} < 65536 THEN 3 ELSE 4 END"
CHECKSUM = "SELECT doc_id, count(*)::BIGINT AS n, sum(sym)::BIGINT AS total, max(sym)::INTEGER AS largest, sum((pos % 1009) * sym)::BIGINT AS checksum FROM s GROUP BY doc_id"
POINTS = f"{CHARS}, p AS (SELECT sym AS cp, count(*) AS n FROM s GROUP BY sym)"

SQL["tok_codepoints"] = f"WITH {CHARS} {CHECKSUM}"
SQL["tok_bytes"] = f"WITH {BYTES} {CHECKSUM}"
SQL["tok_octet_width"] = f"WITH {CHARS} SELECT lang, {WIDTH.format('sym')} AS width, count(*) AS n FROM s GROUP BY ALL"
SQL["tok_class_counts"] = f"WITH {POINTS} SELECT 'char' AS kind, {WIDTH.format('cp')} AS width, sum(n)::BIGINT AS n, count(*) AS distinct_points FROM p GROUP BY ALL"
SQL["tok_int_simple"] = f"WITH {POINTS} SELECT cp, cp AS number, 'char' AS kind, cp AS idx FROM p"
SQL["tok_int_detailed"] = f"WITH {POINTS} SELECT cp, CASE WHEN cp < 55296 THEN cp ELSE cp - 2048 END AS number, 'char' AS kind, cp AS back FROM p"
_starts = sorted(S.FIRST.items(), key=lambda kv: kv[1])
_sizes = {k: b - a for (k, a), b in zip(_starts, [v for _, v in _starts[1:]] + [S.DETAILED_RANGE], strict=True)}
SQL["tok_int_roundtrip"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {_sizes[k]}::BIGINT, 0::BIGINT, {v})" for k, v in _starts) + ") AS t(kind, n, mismatches, first)"
SQL["tok_encode_octets"] = f"WITH {POINTS} SELECT cp, hex(encode(chr(cp))) AS octets FROM p"
SQL["tok_malformed"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{h}', '{d}', '{s}', '{h}')" for h, d, s in fixtures.MALFORMED)
    + ") AS t(hex, detailed, simple, back)"
)
SQL["tok_text"] = f"WITH {POINTS} SELECT cp, printf('UnicodeCharacter(%X)', cp) AS token, CASE WHEN cp < 55296 THEN cp ELSE cp - 2048 END AS number FROM p"
SQL["roundtrip_utf8"] = "SELECT count(*) AS n, 0::BIGINT AS mismatches FROM documents WHERE text <> ''"

HIST = f"{CHARS}, hist AS (SELECT lang, sym, count(*) AS n FROM s GROUP BY ALL)"
SQL["hist_codepoint"] = f"WITH {HIST} SELECT * FROM hist"
SQL["hist_byte"] = f"WITH {BYTES} SELECT sym, count(*) AS n FROM s GROUP BY sym"
WORDS = f"{DOCS}, w AS (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS word FROM d), hist AS (SELECT word, count(*) AS n FROM w GROUP BY word)"
SQL["hist_words"] = f"WITH {WORDS} SELECT * FROM hist"
SQL["hist_width_bucket"] = "SELECT CASE WHEN length(text) < 20000 THEN CAST(floor(length(text) / 500.0) AS INTEGER) ELSE -1 END AS bin, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL"
SQL["hist_merge"] = f"WITH {CHARS} SELECT lower(ch) AS label, count(*) AS n FROM c WHERE ch <> ' ' GROUP BY ALL"
SQL["hist_invert"] = f"WITH {WORDS} SELECT n, count(*) AS bins FROM hist GROUP BY n"
SQL["hist_add"] = SQL["hist_byte"].replace("FROM s GROUP", "FROM s WHERE lang IS NOT NULL GROUP")

ENTROPY = "sum(n)::BIGINT AS total, count(*) AS distinct, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy"
SQL["entropy_order0"] = f"WITH {CHARS}, hist AS (SELECT doc_id, sym, count(*) AS n FROM s GROUP BY ALL) SELECT doc_id, {ENTROPY} FROM hist GROUP BY doc_id"
SQL["entropy_by_lang"] = f"WITH {HIST} SELECT lang, {ENTROPY} FROM hist GROUP BY lang"
SQL["entropy_order1"] = f"""WITH {CHARS}, x AS (SELECT coalesce(lag(sym) OVER (PARTITION BY doc_id ORDER BY pos), -1) AS ctx, sym FROM s),
p AS (SELECT ctx, sym, count(*) AS n FROM x GROUP BY ALL), q AS (SELECT ctx, sum(n) AS m, sum(n * log2(n)) AS z FROM p GROUP BY ctx)
SELECT sum(m)::BIGINT AS total, round(sum(m * log2(m) - z) / sum(m), 6) AS entropy FROM q"""

SQL["bits_uniform_byte"] = "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_symbols, round(octet_length(encode(text)) * log2(257.0::DOUBLE), 3) AS bits FROM documents WHERE text <> ''"


def _static(mass: str) -> str:
    return f"WITH {CHARS} SELECT doc_id, count(*) AS n_symbols, round(sum(-log2({mass})), 3) AS bits FROM s GROUP BY doc_id"


SQL["bits_uniform_stoken"] = _static(f"1.0::DOUBLE / {S.SIMPLE_RANGE}")
SQL["bits_uniform_token"] = _static(f"1.0::DOUBLE / {S.DETAILED_RANGE}")
SQL["bits_categorical"] = _static(f"{dict(CATEGORY_WEIGHTS)['char']}.0::DOUBLE / 100 / {S.CHARACTERS}")
_total = sum((b - a + 1) * w for a, b, w in RANDOM_BYTES)
SQL["bits_random_bytes"] = _static("CASE " + " ".join(f"WHEN sym <= {b} THEN {w}.0::DOUBLE / {_total}" for _, b, w in RANDOM_BYTES) + " END")

TOTAL = "SELECT doc_id, count(*) AS n_symbols, round(sum(-log2(mass)), 3) AS bits FROM m GROUP BY doc_id"


def _counts(source: str = "s") -> str:
    return (
        f"k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sym ORDER BY pos) - 1 AS nx, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM {source}), "
        "r AS (SELECT *, coalesce(sum(CASE WHEN nx = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM k)"
    )


def _crp(a: float, b: float, size: int, source: str = "s") -> str:
    base = f"(1.0::DOUBLE / {size})"
    return (
        f"{_counts(source)}, m AS (SELECT *, CASE WHEN n + {a} = 0 THEN {base} ELSE "
        f"((CASE WHEN nx > 0 THEN nx - {b}::DOUBLE ELSE 0 END) + ({a}::DOUBLE + {b}::DOUBLE * u) * {base}) / (n + {a}::DOUBLE) END AS mass FROM r)"
    )


SQL["bits_crp"] = f"WITH {CHARS}, {_crp(1.0, 0.0, S.SIMPLE_RANGE)} {TOTAL}"
SQL["bits_crp_py"] = f"WITH {CHARS}, {_crp(0.25, 0.5, S.SIMPLE_RANGE)} {TOTAL}"
SQL["bits_crp_lineitem"] = (
    "WITH s AS (SELECT l_partkey AS doc_id, unicode(l_returnflag) AS sym, l_orderkey * 16 + l_linenumber AS pos FROM lineitem), " + f"{_crp(1.0, 0.0, 257)} {TOTAL}"
)
SQL["bps_curve"] = f"""WITH {CHARS}, {_crp(1.0, 0.0, S.SIMPLE_RANGE)},
z AS (SELECT doc_id, pos + 1 AS n, sum(-log2(mass)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM m)
SELECT doc_id, n::BIGINT AS n, round(b / n, 6) AS bps FROM z WHERE n % 500 = 0"""


def _polya(size: int, a: float) -> str:
    levels, at = [], "t0"
    steps = (size - 1).bit_length()
    levels.append(f"t0 AS (SELECT doc_id, pos, sym, 0 AS lo, {size - 1} AS hi, 1.0::DOUBLE AS mass FROM s)")
    for i in range(steps):
        mid = "(lo + (hi - lo + 1) // 2)"
        frame = "OVER (PARTITION BY doc_id, lo, hi ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        levels.append(
            f"v{i} AS (SELECT *, {mid} AS mid, CAST(sym >= {mid} AS INTEGER) AS r, count(*) {frame} AS cnt, coalesce(sum(CAST(sym >= {mid} AS INTEGER)) {frame}, 0) AS ones FROM {at})"
        )
        levels.append(
            f"t{i + 1} AS (SELECT doc_id, pos, sym, CASE WHEN hi > lo AND r = 1 THEN mid ELSE lo END AS lo, CASE WHEN hi > lo AND r = 0 THEN mid - 1 ELSE hi END AS hi, "
            f"mass * CASE WHEN hi > lo THEN ((CASE WHEN r = 1 THEN ones ELSE cnt - ones END) + {a}) / (cnt + 2 * {a}) ELSE 1 END AS mass FROM v{i})"
        )
        at = f"t{i + 1}"
    return ", ".join(levels) + f", m AS (SELECT * FROM {at})"


SQL["bits_polya_byte"] = f"WITH {BYTES}, {_polya(257, 0.5)} {TOTAL}"


def _order_k(k: int, size: int, a: float) -> str:
    lags = ", ".join(f"lag(sym, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS l{i}" for i in range(1, k + 1))
    keys = ", ".join(f"l{i}" for i in range(1, k + 1))
    return (
        f"x AS (SELECT *, {lags} FROM s), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {keys}, sym ORDER BY pos) - 1 AS nx, "
        f"row_number() OVER (PARTITION BY doc_id, {keys} ORDER BY pos) - 1 AS n FROM x), m AS (SELECT doc_id, (nx + {a}) / (n + {a * size}) AS mass FROM y)"
    )


SQL["bits_order1_kt"] = f"WITH {BYTES}, {_order_k(1, 257, 0.5)} {TOTAL}"
SQL["bits_order2_kt"] = f"WITH {BYTES}, {_order_k(2, 257, 0.5)} {TOTAL}"


def _levels(depth: int) -> tuple[str, str]:
    """One-table counts of contexts 0..depth before each position, as CTEs and the name of the last."""
    lags = "".join(f", lag(sym, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS l{i}" for i in range(1, depth + 1))
    steps = [f"a{depth + 1} AS (SELECT doc_id, pos, sym{lags}, least(pos, {depth}) AS depth FROM s)"]
    for k in range(depth, -1, -1):
        keys = "".join(f", l{i}" for i in range(1, k + 1))
        event = f"CAST(depth = {k} AS INTEGER)" if k == depth else f"CAST(depth = {k} OR (depth > {k} AND e{k + 1} = 1 AND nx{k + 1} = 0) AS INTEGER)"
        part = f"doc_id, depth >= {k}{keys}"
        frame = "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        steps.append(f"b{k} AS (SELECT *, {event} AS e{k} FROM a{k + 1})")
        steps.append(f"c{k} AS (SELECT *, coalesce(sum(e{k}) OVER (PARTITION BY {part}, sym {frame}), 0) AS nx{k}, coalesce(sum(e{k}) OVER (PARTITION BY {part} {frame}), 0) AS n{k} FROM b{k})")
        steps.append(f"a{k} AS (SELECT *, coalesce(sum(CASE WHEN e{k} = 1 AND nx{k} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {part} {frame}), 0) AS u{k} FROM c{k})")
    return ", ".join(steps), "a0"


def _mixed(depth: int, one) -> str:
    """Masses by a function of (level, mass so far)."""
    steps, last = _levels(depth)
    steps += f", m_ AS (SELECT *, 1.0::DOUBLE / {S.SIMPLE_RANGE} AS mass FROM {last})"
    at = "m_"
    for k in range(depth + 1):
        steps += f", m{k} AS (SELECT * REPLACE (CASE WHEN depth < {k} OR n{k} = 0 THEN mass ELSE {one(k)} END AS mass) FROM {at})"
        at = f"m{k}"
    return f"{steps}, m AS (SELECT doc_id, mass FROM {at})"


def _blend(alpha: str, beta: str):
    def one(k: int) -> str:
        a, b = alpha.format(k=k) if "{" in alpha else alpha, beta.replace("$u", f"u{k}")
        return f"((CASE WHEN nx{k} > 0 THEN nx{k} - {b} ELSE 0 END) + ({a} + u{k} * {b}) * mass) / (n{k} + {a})"

    return one


SQL["bits_ppmd_noexcl"] = f"WITH {CHARS}, {_mixed(2, lambda k: f'CASE WHEN nx{k} > 0 THEN (2 * nx{k} - 1)::DOUBLE / (2 * n{k}) ELSE u{k}::DOUBLE / (2 * n{k}) * mass END')} {TOTAL}"
SQL["bits_blending_py"] = f"WITH {CHARS}, {_mixed(2, _blend('0.25::DOUBLE', '0.5::DOUBLE'))} {TOTAL}"


def _depth_blend(k: int) -> str:
    return _blend(f"{[0.5, 0.1][k]}::DOUBLE", "([0.7, 0.6, 0.5]::DOUBLE[])[CAST(greatest(least($u, 3), 1) AS BIGINT)]")(k)


SQL["bits_blending_depth"] = f"WITH {CHARS}, {_mixed(1, _depth_blend)} {TOTAL}"


def _matrix_blend(k: int) -> str:
    a, b = [[0.5, 0.4], [0.1, 0.2]][k], [[0.7, 0.6, 0.5], [0.4, 0.3, 0.2]][k]
    pick = "({0}::DOUBLE[])[CAST(greatest(least(u{1}, {2}), 1) AS BIGINT)]"
    return _blend(pick.format(a, k, 2), pick.format(b, k, 3))(k)


SQL["bits_blending_matrix"] = f"WITH {CHARS}, {_mixed(1, _matrix_blend)} {TOTAL}"
SQL["bits_bernoulli"] = f"""WITH {CHARS}, h2 AS (SELECT *, CAST(sym = 32 AS INTEGER) AS hit FROM s),
q AS (SELECT *, coalesce(sum(hit) OVER w, 0) AS ones, count(*) OVER w AS n FROM h2 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT doc_id, ((CASE WHEN hit = 1 THEN ones ELSE n - ones END) + 0.5) / (n + 1.0) AS mass FROM q) {TOTAL}"""

SQL["cumulative_intervals"] = f"""WITH {HIST} SELECT lang, sym, n, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo,
sum(n) OVER (PARTITION BY lang ORDER BY sym)::BIGINT AS hi, sum(n) OVER (PARTITION BY lang)::BIGINT AS total FROM hist"""
GRAMS = f"{DOCS}, g AS (SELECT lang, substring(text, i, 3) AS gram FROM (SELECT lang, text, unnest(generate_series(1, length(text) - 2)) AS i FROM d WHERE length(text) >= 3))"
SQL["ngram_topk"] = f"WITH {GRAMS}, k AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL) SELECT lang, gram, n FROM k QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 20"
SQL["ngram_distinct"] = f"WITH {GRAMS} SELECT lang, count(DISTINCT gram) AS distinct_grams, count(*) AS n FROM g GROUP BY lang"
SQL["most_probable_symbol"] = f"WITH {HIST} SELECT lang, sym, n FROM hist QUALIFY rank() OVER (PARTITION BY lang ORDER BY n DESC) = 1"
SQL["roundtrip_coder"] = SQL["roundtrip_utf8"]

RESULTS = f"""{DOCS}, z AS (SELECT doc_id AS file, lang, source, octet_length(encode(text))::BIGINT AS size, length(text)::DOUBLE AS chars,
 len(regexp_extract_all(text, '{WORD}'))::DOUBLE AS words, (2 * octet_length(encode(text)))::DOUBLE AS hex FROM d),
res AS (SELECT file, lang, source, size, 'chars' AS algo, chars AS csize FROM z UNION ALL SELECT file, lang, source, size, 'words', words FROM z UNION ALL SELECT file, lang, source, size, 'hex', hex FROM z)"""
SQL["bench_wide"] = f"WITH {RESULTS} SELECT file, size, chars, hex, words FROM z"
SQL["bench_long"] = f"""WITH {RESULTS} SELECT file, size, algo, CASE WHEN algo = 'words' AND csize <= 100 THEN NULL ELSE csize END AS csize,
CASE WHEN algo = 'words' AND csize <= 100 THEN 'ERROR: too short' ELSE 'ok' END AS status,
CASE WHEN algo = 'words' AND csize <= 100 THEN NULL ELSE round(csize / size * 8, 6) END AS bits_per_byte FROM res"""
SQL["best_algo"] = f"WITH {RESULTS} SELECT file, algo, csize, csize = min(csize) OVER (PARTITION BY file) AS best FROM res"
SQL["mean_effectiveness"] = f"WITH {RESULTS} SELECT algo, round(avg(csize / size * 8), 6) AS mean FROM res GROUP BY algo"
SQL["group_summary_rollup"] = f"""WITH {RESULTS} SELECT CASE WHEN grouping(lang) = 1 THEN 'All' ELSE lang END AS grp, algo, round(avg(csize / size * 8), 6) AS mean
FROM res GROUP BY GROUPING SETS ((lang, algo), (algo))"""
SQL["autoscale"] = f"WITH {RESULTS} SELECT round(min(csize / (size - 85)), 6) AS low, round(max(csize / (size - 85)), 6) AS high FROM res WHERE size <> 85"


def _values(name: str) -> str:
    return "(VALUES " + ", ".join(f"({d}, {a}::DOUBLE, {b}::DOUBLE, {m}::DOUBLE)" for d, a, b, m in fixtures.PARAMETERS[name]) + ")"


_WIDE = f"""SELECT depth, b.a AS byte_alpha, b.b AS byte_beta, b.m AS byte_mean_efficiency, t.a AS token_alpha, t.b AS token_beta, t.m AS token_mean_efficiency
FROM {_values('byte')} AS b(depth, a, b, m) JOIN {_values('token')} AS t(depth, a, b, m) USING (depth)"""
SQL["params_consolidate"] = _WIDE
SQL["params_argmin"] = f"""WITH w AS ({_WIDE}), l AS (SELECT depth, 'byte' AS prior, byte_alpha AS alpha, byte_beta AS beta, byte_mean_efficiency AS mean_efficiency FROM w
UNION ALL SELECT depth, 'token', token_alpha, token_beta, token_mean_efficiency FROM w)
SELECT prior, depth, alpha, beta, mean_efficiency FROM l QUALIFY row_number() OVER (PARTITION BY prior ORDER BY mean_efficiency, depth) = 1"""
SQL["params_delta"] = """WITH t AS (SELECT l_linestatus AS prior,
avg(l_discount) FILTER (l_quantity < 25 AND l_linenumber < 3) AS tt, avg(l_discount) FILTER (l_quantity < 25 AND l_linenumber >= 3) AS tm,
avg(l_discount) FILTER (l_quantity >= 25 AND l_linenumber < 3) AS mixed, avg(l_discount) FILTER (l_quantity >= 25 AND l_linenumber >= 3) AS ee FROM lineitem GROUP BY 1)
SELECT prior, round(tt - ee, 6) AS total, round(mixed - ee, 6) AS by_depth, round(tt - mixed, 6) AS by_parameters FROM t"""
SQL["resource_mean_sem"] = "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value) / sqrt(count(value)), 6) AS error FROM events GROUP BY event_type"
SQL["efficiency_by_depth"] = f"""WITH {RESULTS}, p AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {r[0]})" for n, rows in fixtures.PARAMETERS.items() for r in rows)}) AS t(prior, depth)),
sc AS (SELECT lang AS set, CASE WHEN algo = 'hex' THEN 'byte' ELSE 'token' END AS prior, CAST(file % 10 AS INTEGER) AS depth, csize / size * 8 AS e FROM res)
SELECT set, prior, depth, round(avg(e), 6) AS mean FROM p JOIN sc USING (prior, depth) GROUP BY ALL"""
SQL["json_corpus"] = f"""WITH {RESULTS}, j AS (SELECT source || '/' || lang AS corpus, algo, '"' || algo || '":[' || string_agg(CAST(CAST(ceil(csize) AS BIGINT) AS VARCHAR), ',' ORDER BY file) || ']' AS t FROM res GROUP BY 1, 2)
SELECT corpus, '{{' || string_agg(t, ',' ORDER BY algo) || '}}' AS json FROM j GROUP BY corpus"""

SQL["corpus_include_exclude"] = """SELECT page_id, url FROM pages WHERE (regexp_matches(url, '^http[^/]*://[^/]*\\.example\\.org/[^/]*/[^/]*$') OR regexp_matches(url, '^http://[^/]*\\.example\\.com/[^/]*$'))
AND NOT regexp_matches(url, '^[^/]*://blog\\.[^/]*/[^/]*/[^/]*$')"""
_names = ", ".join(f"('{n}')" for n in grid_names())
SQL["algo_regex_filter"] = f"SELECT algo FROM (VALUES {_names}) AS t(algo) WHERE regexp_matches(algo, '^(ppm[0-3]|lzw|none)') AND algo NOT LIKE '%_lzw_byte' AND NOT regexp_matches(algo, '^ppm.*uniform_token')"
SQL["work_grid"] = f"SELECT lang, algo, count(*) AS items, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents, (VALUES {_names}) AS t(algo) GROUP BY ALL"
SQL["md5_topn_per_lang"] = "SELECT lang, doc_id, md5(text) AS digest, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5(text), doc_id) AS INTEGER) AS rank FROM documents WHERE text <> '' QUALIFY rank <= 5"
_SPEAKERS = "sp AS (SELECT source, sum(octet_length(encode(text)))::BIGINT AS population FROM documents GROUP BY source)"
_CUM = f"{_SPEAKERS}, cu AS (SELECT source, population, sum(population) OVER (ORDER BY source)::BIGINT AS upto, sum(population) OVER ()::DOUBLE AS total FROM sp)"
SQL["cumulative_population"] = f"WITH {_CUM} SELECT source, population, upto, upto - population AS before FROM cu"
SQL["pps_systematic_sample"] = f"""WITH {_CUM}, pt AS (SELECT (0.5 + i) / 12.0 AS f FROM generate_series(0, 11) AS t(i))
SELECT source, population, count(*)::INTEGER AS hits FROM cu JOIN pt ON f * total >= upto - population AND f * total < upto GROUP BY ALL"""
SQL["language_subset"] = """WITH q AS (SELECT lang, count(*) AS w FROM documents GROUP BY lang), cu AS (SELECT lang, w, sum(w) OVER (ORDER BY lang) AS upto, sum(w) OVER () AS total FROM q),
pt AS (SELECT (0.5 + i) / 20.0 AS f FROM generate_series(0, 19) AS t(i)), h AS (SELECT lang, count(*) AS hits FROM cu JOIN pt ON f * total >= upto - w AND f * total < upto GROUP BY lang),
r AS (SELECT lang, doc_id, md5(text) AS digest, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5(text), doc_id) AS INTEGER) AS rank FROM documents WHERE text <> '')
SELECT lang, doc_id, digest, rank FROM r JOIN h USING (lang) WHERE rank <= hits"""
SQL["legal_param_grid"] = """WITH g AS (SELECT id, -0.5 + 1.5 * (id // 13) / 12.0::DOUBLE AS a, -0.25 + 1.5 * (id % 13) / 12.0::DOUBLE AS b FROM range(169) AS t(id))
SELECT id, round(a, 6) AS alpha, round(b, 6) AS beta, b >= 0 AND b <= 1 AND a + b >= 0.01 AS legal FROM g"""
SQL["file_sizes"] = """WITH z AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, source, lang FROM documents)
SELECT doc_id, size, CAST(floor(log2(greatest(size, 1))) AS INTEGER) AS magnitude, CAST(CASE WHEN size = 0 THEN 1 ELSE pow(2, floor(log2(size)) + 1) END AS BIGINT) AS next_power, source || '_' || lang AS name FROM z"""
SQL["line_counts"] = "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::INTEGER AS longest FROM documents WHERE text <> ''"
SQL["bit_counts"] = """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents WHERE text <> '')
SELECT doc_id, (8 * count(*))::BIGINT AS n_bits, sum(bit_count(CAST('0x' || h AS INTEGER)))::BIGINT AS ones FROM b GROUP BY doc_id"""
SQL["special_functions"] = """WITH r AS (SELECT (id + 1) / 4.0::DOUBLE AS x FROM range(200) AS t(id))
SELECT x, round(lgamma(x), 6) AS log_gamma, round(lgamma(x) + lgamma(2.5) - lgamma(x + 2.5), 6) AS log_beta, round(1 / (1 + exp(-x)), 6) AS inverse_logit,
round(2 * x + ln(exp(-x) + 1 + exp(-3 * x)), 6) AS log_sum_exp, round(ln((x + 3) * (x + 2) / 2), 6) AS log_choose FROM r"""
_PI = "2.5066282746310002"
SQL["distribution_masses"] = f"""WITH p AS (SELECT p_partkey, p_size / 51.0::DOUBLE AS x, p_size::DOUBLE AS k FROM part)
SELECT p_partkey, round(lgamma(61.0) - lgamma(k + 1) - lgamma(61 - k) + k * ln(0.4) + (60 - k) * ln(0.6), 6) AS binomial,
round(ln(x) + 2.5 * ln(1 - x) - lgamma(2.0) - lgamma(3.5) + lgamma(5.5), 6) AS beta,
round(1.5 * ln(k) - k / 4.0 - lgamma(2.5) - 2.5 * ln(4.0), 6) AS gamma,
round(-(k - 25) * (k - 25) / 200.0 - ln({_PI}) - 0.5 * ln(100.0), 6) AS gaussian,
round(0.25 * exp(-(k - 10) * (k - 10) / 50.0) / ({_PI} * 5) + 0.75 * exp(-(k - 40) * (k - 40) / 50.0) / ({_PI} * 5), 6) AS mixture FROM p"""

# Sizes of packed texts cannot be said in SQL; that they unpack to the text and are as long as what was coded can.
_ALL = "FROM documents"
_SIZE = "octet_length(encode(coalesce(text, '')))::BIGINT AS size"
for _name in ("size_lzw", "size_lzw_escape", "size_lzw_polya", "size_ppm", "size_ppm_polya"):
    SQL[_name] = f"SELECT doc_id, {_SIZE}, true AS same, true AS as_coded {_ALL}"
for _name in ("size_gzip", "size_bzip2", "size_lzma"):
    SQL[_name] = f"SELECT doc_id, {_SIZE}, 'ok' AS status, true AS bounded {_ALL}"
SQL["size_crp"] = SQL["bits_crp"].replace("SELECT doc_id, count(*) AS n_symbols", "SELECT doc_id, true AS agree, count(*) AS n_symbols")
SQL["coder_trace"] = f"SELECT doc_id, {_SIZE}, true AS enough, true AS inside {_ALL}"
SQL["predictive_entropy"] = "SELECT doc_id, octet_length(encode(text))::BIGINT AS n, true AS inside FROM documents WHERE text <> ''"
SQL["generated_texts"] = "SELECT id, true AS bounded, true AS same FROM range(20) AS t(id)"
SQL["mtf_rank"] = f"""WITH {BYTES}, w AS (SELECT doc_id, pos, sym, lag(sym) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM s),
z AS (SELECT doc_id, count(*) AS n, count(*) FILTER (sym = coalesce(before, 0)) AS zeros FROM w GROUP BY doc_id),
x AS (SELECT doc_id, sym, lag(sym) OVER v AS one, lag(sym, 2) OVER v AS two FROM w WHERE before IS NULL OR before <> sym WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
o AS (SELECT doc_id, count(*) FILTER (sym = CASE WHEN one IS NULL THEN 1 WHEN two IS NULL THEN CASE one WHEN 0 THEN 1 ELSE 0 END ELSE two END) AS ones FROM x GROUP BY doc_id),
f AS (SELECT doc_id, sym, min(pos) AS first FROM s GROUP BY ALL),
r AS (SELECT a.doc_id, sum(a.sym)::BIGINT + (SELECT count(*) FROM f b JOIN f c ON b.doc_id = c.doc_id AND c.first < b.first AND c.sym > b.sym WHERE b.doc_id = a.doc_id) AS firsts FROM f a GROUP BY a.doc_id)
SELECT doc_id, n::BIGINT AS n, zeros::BIGINT AS zeros, ones::BIGINT AS ones, firsts::BIGINT AS firsts FROM z JOIN o USING (doc_id) JOIN r USING (doc_id)"""
SQL["contour_grid"] = """WITH g AS (SELECT id, 0.5 * (id // 4) / 3.0::DOUBLE AS a, 0.9 * (id % 4) / 3.0::DOUBLE AS b FROM range(16) AS t(id)), l AS (SELECT *, a + b >= 0.01 AS legal FROM g)
SELECT id, round(a, 6) AS alpha, round(b, 6) AS beta, legal, CASE WHEN legal THEN true END AS inside FROM l"""
_tests = ", ".join(f"('{n}')" for n in experiments.algorithms({"training": fixtures.tuned_rows()}))
SQL["benchmark_grid"] = f"""SELECT algo, count(*) AS files, count(*) AS good, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes
FROM benchmark, (VALUES {_tests}) AS t(algo) GROUP BY algo"""
SQL["resource_usage"] = """SELECT algo, 'ok' AS status, count(*) AS files, true AS steady, true AS sane
FROM documents, (VALUES ('ref_gzip'), ('ppm2_uniform_byte'), ('lzw_uniform_byte')) AS t(algo) GROUP BY algo"""
_PARTS = CHARS.replace(DOCS, "d AS (SELECT p_partkey AS doc_id, p_name AS text, '' AS lang FROM part)")
SQL["bits_polya_stoken"] = f"WITH {_PARTS}, {_polya(S.SIMPLE_RANGE, 0.5)} {TOTAL}"


def _between(lo: str, hi: str) -> str:
    return "(" + " + ".join(f"greatest(least({hi}, {b}) - greatest({lo}, {a}) + 1, 0)::BIGINT * {w}" for a, b, w in RANDOM_BYTES) + ")"


def _mass_polya(size: int) -> str:
    at, levels = "t0", [f"t0 AS (SELECT doc_id, pos, sym, 0 AS lo, {size - 1} AS hi, 1.0::DOUBLE AS mass FROM s)"]
    mid = "(lo + (hi - lo + 1) // 2)"
    frame = "OVER (PARTITION BY doc_id, lo, hi ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    for i in range((size - 1).bit_length()):
        levels += [
            f"v{i} AS (SELECT *, {mid} AS mid, CAST(sym >= {mid} AS INTEGER) AS r, count(*) {frame} AS cnt, coalesce(sum(CAST(sym >= {mid} AS INTEGER)) {frame}, 0) AS ones, "
            f"{_between('lo', 'hi')} AS whole, {_between(mid, 'hi')} AS rm FROM {at})",
            f"p{i} AS (SELECT *, greatest(CAST(pow(2, length(bin(whole))) AS HUGEINT) // 256, 1) AS scale FROM v{i})",
            f"q{i} AS (SELECT *, greatest(rm // scale, 1) AS y, greatest(whole // scale - greatest(rm // scale, 1), 1) AS x FROM p{i})",
            f"t{i + 1} AS (SELECT doc_id, pos, sym, CASE WHEN hi > lo AND r = 1 THEN mid ELSE lo END AS lo, CASE WHEN hi > lo AND r = 0 THEN mid - 1 ELSE hi END AS hi, "
            f"mass * CASE WHEN hi > lo THEN ((CASE WHEN r = 1 THEN ones ELSE cnt - ones END) + (CASE WHEN r = 1 THEN y ELSE x END)::DOUBLE / (x + y) * 0.5) / (cnt + 0.5) ELSE 1 END AS mass FROM q{i})",
        ]
        at = f"t{i + 1}"
    return ", ".join(levels) + f", m AS (SELECT * FROM {at})"


SQL["bits_polya_random"] = f"WITH {_PARTS}, {_mass_polya(S.SIMPLE_RANGE)} {TOTAL}"
SQL["int_items"] = "SELECT l_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS total FROM lineitem GROUP BY l_orderkey"
SQL["symbol_sampling"] = """WITH h AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), c AS (SELECT lang, sum(n) OVER (ORDER BY lang) AS upto, n, sum(n) OVER ()::DOUBLE AS whole FROM h)
SELECT lang, count(*) AS hits FROM c JOIN range(1000) AS t(id) ON (id + 0.5) / 1000 >= (upto - n) / whole AND (id + 0.5) / 1000 < upto / whole GROUP BY lang"""
SQL["collected_values"] = "SELECT l_orderkey, string_agg(printf('%.2f', l_discount::DOUBLE), ',' ORDER BY l_discount) AS discounts FROM lineitem WHERE l_discount IS NOT NULL GROUP BY l_orderkey"
SQL["pps_without_replacement"] = f"""WITH {_SPEAKERS} SELECT source, population FROM sp WHERE population > 0
ORDER BY -ln((CAST('0x' || substr(md5('0:' || source), 1, 12) AS BIGINT)::DOUBLE + 1) / 281474976710657.0) / population, source LIMIT 5"""
SQL["longest_row_text"] = """WITH r AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, 'li>', 'tr>', 'g'), '(?is)<tr[^>]*>(.*?)</tr>', 1)) AS x, html FROM pages),
t AS (SELECT page_id, trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS row, row_number() OVER () AS k FROM r)
SELECT page_id, coalesce((SELECT row FROM t WHERE t.page_id = p.page_id ORDER BY length(row) DESC, k LIMIT 1), '') AS row FROM pages p"""
