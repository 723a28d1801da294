"""Registered queries of the core library; their SQL is in ``quillbit.plans.oracle``."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbit.functions import special, text
from quillbit.functions import symbols as S
from quillbit.operators import adaptive as A
from quillbit.operators import counting as C
from quillbit.operators import distributions as D
from quillbit.operators import generate
from quillbit.operators import histogram as H
from quillbit.operators import report as R
from quillbit.operators import sampling, search
from quillbit.plans import experiments, fixtures, oracle, score
from quillbit.plans.spec import grid_names, parse
from quillbit.plans.storage import materialise
from quillbit.sources import corpus, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text; models are defined over at least one symbol."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").where("text <> ''")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits and bits for each byte of ``crp:a=1:b=0`` over uniform tokens, by language, with a row for all."""
    docs = documents(spark, sf_dir)
    rows = A.crp(A.characters(docs, keep=["lang"]), A.uniform_mass(S.SIMPLE_RANGE), 1.0, 0.0)
    per_doc = rows.groupBy("doc_id", "lang").agg(
        F.sum(-F.log2("mass")).alias("bits"), F.sum(S.octet_width(F.col("sym"))).alias("size")
    )
    both = per_doc.select(F.explode(F.array("lang", F.lit("All"))).alias("lang"), "bits", "size")
    return both.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.round(F.sum("bits"), 1).alias("bits"),
        F.round(F.avg(F.col("bits") / F.col("size")), 6).alias("bits_per_byte"),
    )


# --- symbols ------------------------------------------------------------------------------


def _checksum(rows: DataFrame) -> DataFrame:
    at = F.col("pos").cast("long")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.col("sym").cast("long")).alias("total"), F.max("sym").cast("int").alias("largest"),
        F.sum((at % 1009) * F.col("sym")).alias("checksum"),
    )


@query
def tok_codepoints(spark, sf):
    return _checksum(documents(spark, sf).select("doc_id", F.posexplode(S.code_points(F.col("text"))).alias("pos", "sym")))


@query
def tok_bytes(spark, sf):
    return _checksum(documents(spark, sf).select("doc_id", F.posexplode(S.octets(F.col("text"))).alias("pos", "sym")))


@query
def tok_octet_width(spark, sf):
    points = documents(spark, sf).select("lang", F.explode(S.code_points(F.col("text"))).alias("cp"))
    return points.groupBy("lang", S.octet_width(F.col("cp")).alias("width")).agg(F.count("*").alias("n"))


def _points(spark, sf) -> DataFrame:
    """Distinct code points of the corpus, with their count."""
    points = documents(spark, sf).select(F.explode(S.code_points(F.col("text"))).alias("cp"))
    return points.groupBy("cp").agg(F.count("*").alias("n"))


@query
def tok_class_counts(spark, sf):
    return _points(spark, sf).groupBy(S.simple_kind(F.col("cp")).alias("kind"), S.octet_width(F.col("cp")).alias("width")).agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct_points")
    )


@query
def tok_int_simple(spark, sf):
    number = S.simple_number(F.lit("char"), F.col("cp"))
    return _points(spark, sf).select("cp", number.alias("number"), S.simple_kind(number).alias("kind"), S.simple_index(number).alias("idx"))


@query
def tok_int_detailed(spark, sf):
    number = S.detailed_number(F.lit("char"), F.col("cp"), F.lit(None).cast("int"))
    parts = S.detailed_parts(number)
    return _points(spark, sf).select("cp", number.alias("number"), parts["kind"].alias("kind"), parts["cp"].alias("back"))


@query
def tok_int_roundtrip(spark, sf):
    """Every number of the detailed alphabet to its token and back."""
    parts = spark.range(S.DETAILED_RANGE).select(F.col("id").cast("int").alias("number")).withColumn("p", S.detailed_parts(F.col("number")))
    back = S.detailed_number(F.col("p.kind"), F.col("p.cp"), F.col("p.len"))
    return parts.groupBy(F.col("p.kind").alias("kind")).agg(
        F.count("*").alias("n"), F.sum((back != F.col("number")).cast("long")).alias("mismatches"), F.min("number").alias("first")
    )


@query
def tok_encode_octets(spark, sf):
    return _points(spark, sf).select("cp", S.utf8_hex(F.col("cp")).alias("octets"))


@query
def tok_malformed(spark, sf):
    rows = spark.createDataFrame([(h,) for h, _, _ in fixtures.MALFORMED], "hex string")
    out = rows.select("hex", S.decode_column(F.unhex("hex")).alias("d"), S.decode_column(F.unhex("hex"), False).alias("s"))
    show = lambda c: F.array_join(F.transform(c, lambda t: S.token_text(t["kind"], t["cp"], t["len"])), " ")
    return out.select("hex", show(F.col("d")).alias("detailed"), show(F.col("s")).alias("simple"), F.hex(S.encode_column(F.col("d"))).alias("back"))


@query
def tok_text(spark, sf):
    """The token dump of distinct characters."""
    number = S.character_number(F.col("cp"))
    return _points(spark, sf).select("cp", S.token_text(F.lit("char"), F.col("cp"), F.lit(None).cast("int")).alias("token"), number.alias("number"))


@query
def roundtrip_utf8(spark, sf):
    docs = documents(spark, sf)
    back = S.recoded_column(F.encode("text", "UTF-8"))
    return docs.withColumn("back", back).agg(F.count("*").alias("n"), F.sum((F.col("back") != F.encode("text", "UTF-8")).cast("long")).alias("mismatches"))


# --- histograms and entropies ---------------------------------------------------------------


@query
def hist_codepoint(spark, sf):
    points = documents(spark, sf).select("lang", F.explode(S.code_points(F.col("text"))).alias("sym"))
    return H.of_symbols(points, "sym", "lang")


@query
def hist_byte(spark, sf):
    return H.of_symbols(documents(spark, sf).select(F.explode(S.octets(F.col("text"))).alias("sym")))


@query
def hist_words(spark, sf):
    words = documents(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    return H.of_symbols(words, "word")


@query
def hist_width_bucket(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    return H.of_numbers(docs, F.length("text").cast("double"), 0.0, 20000.0, 40)


@query
def hist_merge(spark, sf):
    """Bins of letters of either case merged, white space deleted."""
    points = documents(spark, sf).select(F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("label"))
    return H.delete_bin(H.merge_bins(H.of_symbols(points, "label"), "label", F.lower("label")), "label", " ")


@query
def hist_invert(spark, sf):
    return H.inverted(hist_words(spark, sf))


@query
def hist_add(spark, sf):
    docs = documents(spark, sf)
    a = H.of_symbols(docs.where("lang = 'en'").select(F.explode(S.octets(F.col("text"))).alias("sym")))
    b = H.of_symbols(docs.where("lang <> 'en'").select(F.explode(S.octets(F.col("text"))).alias("sym")))
    return H.add(a, b, "sym")


@query
def entropy_order0(spark, sf):
    points = documents(spark, sf).select("doc_id", F.explode(S.code_points(F.col("text"))).alias("sym"))
    found = H.totals(H.of_symbols(points, "sym", "doc_id"), "doc_id")
    return found.select("doc_id", "total", "distinct", F.round("entropy", 6).alias("entropy"))


@query
def entropy_by_lang(spark, sf):
    found = H.totals(hist_codepoint(spark, sf), "lang")
    return found.select("lang", "total", "distinct", F.round("entropy", 6).alias("entropy"))


@query
def entropy_order1(spark, sf):
    rows = A.characters(documents(spark, sf)).withColumn("ctx", A.context(1))
    return H.conditional_entropy(rows, "ctx").select("total", F.round("entropy", 6).alias("entropy"))


# --- code lengths --------------------------------------------------------------------------


def _static(spark, sf, mass) -> DataFrame:
    """Bits of a static model: one pass over the counts of each document."""
    points = documents(spark, sf).select("doc_id", F.explode(S.code_points(F.col("text"))).alias("sym"))
    counts = H.of_symbols(points, "sym", "doc_id")
    return counts.groupBy("doc_id").agg(F.sum("n").alias("n_symbols"), F.round(F.sum(F.col("n") * -F.log2(mass)), 3).alias("bits"))


@query
def bits_uniform_byte(spark, sf):
    n = F.octet_length("text").cast("long")
    return documents(spark, sf).select("doc_id", n.alias("n_symbols"), F.round(n * F.log2(F.lit(257.0)), 3).alias("bits"))


@query
def bits_uniform_stoken(spark, sf):
    return _static(spark, sf, A.uniform_mass(S.SIMPLE_RANGE))


@query
def bits_uniform_token(spark, sf):
    return _static(spark, sf, A.uniform_mass(S.DETAILED_RANGE))


@query
def bits_categorical(spark, sf):
    return _static(spark, sf, A.categorical_mass(S.character_number(F.col("sym"))))


@query
def bits_random_bytes(spark, sf):
    return _static(spark, sf, A.weighted_mass(F.col("sym")))


def _restaurant_bits(spark, sf, **more: Column) -> DataFrame:
    return C.total_bits(documents(spark, sf), C.code_points, C.bits(C.restaurant(1.0 / S.SIMPLE_RANGE, 1.0, 0.0)), **more)


@query
def bits_crp(spark, sf):
    return _restaurant_bits(spark, sf)


@query
def bits_crp_py(spark, sf):
    return A.total_bits(A.crp(A.characters(documents(spark, sf)), A.uniform_mass(S.SIMPLE_RANGE), 0.25, 0.5))


@query
def bits_crp_lineitem(spark, sf):
    """Return flags of a part's line items as a symbol stream."""
    items = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("doc_id"), F.ascii("l_returnflag").alias("sym"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("pos"),
    )
    return A.total_bits(A.crp(items, A.uniform_mass(257), 1.0, 0.0))


@query
def bits_polya_byte(spark, sf):
    return C.total_bits(documents(spark, sf), C.octets, C.polya_bits(257))


@query
def bits_order1_kt(spark, sf):
    return A.total_bits(A.order_k(A.byte_stream(documents(spark, sf)), 1, 257))


@query
def bits_order2_kt(spark, sf):
    return C.total_bits(documents(spark, sf), C.octets, C.bits(C.order_k(2, 257)))


@query
def bits_ppmd_noexcl(spark, sf):
    return C.total_bits(documents(spark, sf), C.code_points, C.bits(C.ppmd(2, 1.0 / S.SIMPLE_RANGE)))


@query
def bits_blending_py(spark, sf):
    return C.total_bits(documents(spark, sf), C.code_points, C.bits(C.blending(2, 1.0 / S.SIMPLE_RANGE, 0.25, 0.5)))


@query
def bits_blending_depth(spark, sf):
    model = C.blending(1, 1.0 / S.SIMPLE_RANGE, C.by_depth([0.5, 0.1]), C.by_fanout([0.7, 0.6, 0.5]))
    return C.total_bits(documents(spark, sf), C.code_points, C.bits(model))


@query
def bits_bernoulli(spark, sf):
    """Whether a character is a space, by a Beta-Bernoulli process."""
    return A.total_bits(A.bernoulli(A.characters(documents(spark, sf)), F.col("sym") == 32))


@query
def bps_curve(spark, sf):
    return A.bps_curve(A.crp(A.characters(documents(spark, sf)), A.uniform_mass(S.SIMPLE_RANGE), 1.0, 0.0), 500)


@query
def cumulative_intervals(spark, sf):
    return H.cumulative(hist_codepoint(spark, sf), "sym", "lang")


@query
def ngram_topk(spark, sf):
    """The 20 most frequent character trigrams of each language."""
    grams = _trigrams(spark, sf)
    counted = grams.groupBy("lang", "gram").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("r", r).where("r <= 20").select("lang", "gram", "n")


def _trigrams(spark, sf) -> DataFrame:
    """Character trigrams by zipping a split text with itself, linear in its length."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    c = F.col("c")
    two = F.zip_with(c, F.slice(c, 2, F.size(c)), lambda a, b: F.concat(a, b))
    both = F.zip_with(two, F.slice(c, 3, F.size(c)), lambda a, b: F.concat(a, b))
    docs = documents(spark, sf).select("lang", chars.alias("c")).where(F.size("c") >= 3)
    return docs.select("lang", F.explode(F.filter(both, lambda g: g.isNotNull())).alias("gram"))


@query
def ngram_distinct(spark, sf):
    return _trigrams(spark, sf).groupBy("lang").agg(F.countDistinct("gram").alias("distinct_grams"), F.count("*").alias("n"))


@query
def most_probable_symbol(spark, sf):
    return H.extreme_symbols(hist_codepoint(spark, sf), "lang").select("lang", "sym", "n")


# --- coders --------------------------------------------------------------------------------


def every_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a null text is empty, and an empty text is its end mark alone."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _sizes(spark, sf, layer: str, base: str) -> DataFrame:
    """Documents packed, unpacked and compared; the packed bits are those of the masses that were coded, but for rounding.

    Documents are dealt to all cores first: coding a text costs far more than moving it.
    """
    found = score.checked_column(F.col("text"), parse(layer, base))
    docs = A.deal(every_document(spark, sf)).select("doc_id", F.octet_length("text").cast("long").alias("size"), found.alias("c"))
    return docs.select("doc_id", "size", F.col("c.same").alias("same"), (F.abs(F.col("c.bits") - F.col("c.ideal")) <= 3).alias("as_coded"))


@query
def size_lzw(spark, sf):
    return _sizes(spark, sf, "none", "lzw_byte")


@query
def size_lzw_escape(spark, sf):
    return _sizes(spark, sf, "lzwEscape", "uniform_byte")


@query
def size_lzw_polya(spark, sf):
    return _sizes(spark, sf, "lzwEscape", "polya_stoken_uniform_byte")


@query
def size_ppm(spark, sf):
    return _sizes(spark, sf, "ppm:d=5", "uniform_byte")


@query
def size_ppm_polya(spark, sf):
    return _sizes(spark, sf, "ppm:d=4:a=0.0001973:b=0.5131823", "polya_stoken_uniform_byte")


@query
def size_crp(spark, sf):
    """The restaurant's packed bits against its masses as windows say them: (doc_id, n_symbols, bits by windows, agree).

    Both are taken where a document's texts lie after one exchange.
    """
    packed = score.measure_column(C.merged(F.col("texts")), parse("crp:a=1:b=0", "uniform_stoken"))
    found = _restaurant_bits(spark, sf, packed=packed)
    # the end mark comes last: it is new, and one of the tokens that have not been met
    end = F.log2(F.col("n_symbols") + 1.0) + 21
    off = F.col("packed") - F.col("bits")
    return found.select("doc_id", "n_symbols", "bits", ((off >= 0) & (off <= end + 3)).alias("agree"))


def _codec(spark, sf, name: str) -> DataFrame:
    found = score.score_column(F.col("text"), F.lit(f"ref_{name}"), True)
    docs = A.deal(every_document(spark, sf)).select("doc_id", F.octet_length("text").cast("long").alias("size"), found.alias("r"))
    # 64 bytes of head and table, and a codec never adds more than a hundredth to what it cannot pack
    return docs.select("doc_id", "size", "r.status", (F.col("r.csize") <= F.col("size") * 1.01 + 64).alias("bounded"))


@query
def size_gzip(spark, sf):
    return _codec(spark, sf, "gzip")


@query
def size_bzip2(spark, sf):
    return _codec(spark, sf, "bzip2")


@query
def size_lzma(spark, sf):
    return _codec(spark, sf, "lzma")


@query
def roundtrip_coder(spark, sf):
    """Documents that packing and unpacking by PPM changes: none."""
    spec = parse("ppm:d=3", "uniform_stoken")
    docs = A.deal(documents(spark, sf)).withColumn("back", score.decompress_column(score.compress_column(F.col("text"), spec), spec))
    return docs.agg(F.count("*").alias("n"), F.sum((F.col("back") != F.encode("text", "UTF-8")).cast("long")).alias("mismatches"))


@query
def coder_trace(spark, sf):
    """Steps of the coder over documents: one for each symbol and the end at least, no region outside its total."""
    spec = parse("ppm:d=2", "uniform_byte")
    docs = A.deal(every_document(spark, sf)).select("doc_id", F.octet_length("text").cast("long").alias("size"), score.regions_column(F.col("text"), spec).alias("r"))
    return docs.select("doc_id", "size", (F.col("r.steps") > F.col("size")).alias("enough"), "r.inside")


@query
def mtf_rank(spark, sf):
    """Ranks of bytes in a move-to-front list: (doc_id, bytes, rank 0, rank 1, sum of ranks where a byte comes first)."""
    docs = A.deal(documents(spark, sf)).select("doc_id", S.octets(F.col("text")).alias("b"), score.ranks_column(F.col("text")).alias("r"))
    first = F.aggregate(F.array_distinct("b"), F.lit(0).cast("long"), lambda s, x: s + F.element_at(F.col("r"), F.array_position(F.col("b"), x).cast("int")))

    def having(rank: int) -> F.Column:
        return F.size(F.filter("r", lambda r: r == rank)).cast("long")

    return docs.select("doc_id", F.size("b").cast("long").alias("n"), having(0).alias("zeros"), having(1).alias("ones"), first.alias("firsts"))


@query
def predictive_entropy(spark, sf):
    """What PPM expects before each byte of a document, over letters and marks and the end: entropies within their bounds."""
    docs = A.deal(documents(spark, sf))
    found = generate.entropies_column(F.col("text"), parse("ppm:d=1", "uniform_byte"), list(range(32, 127)))
    most = math.log2(96) + 1e-9
    inside = F.forall("e", lambda x: (x >= 0) & (x <= most))
    return docs.select("doc_id", found.alias("e")).select("doc_id", F.size("e").cast("long").alias("n"), inside.alias("inside"))


@query
def generated_texts(spark, sf):
    """Symbols drawn from a model, by seed: as many as asked for or up to the end mark, and the same again for the same seed."""
    rows = generate.generated(spark, parse("ppm:d=1", "uniform_byte"), 20, 200)
    again = generate.generated(spark, parse("ppm:d=1", "uniform_byte"), 20, 200).select("id", F.col("symbols").alias("again"))
    both = rows.join(again, "id")
    return both.select("id", F.size("symbols").between(0, 200).alias("bounded"), (F.col("symbols") == F.col("again")).alias("same"))


# --- result tables ---------------------------------------------------------------------------


def _results(spark, sf) -> DataFrame:
    """Documents as files, with three sizes that stand for algorithms."""
    docs = documents(spark, sf)
    size = F.octet_length("text").cast("long")
    algos = F.array(
        F.struct(F.lit("chars").alias("algo"), F.length("text").cast("double").alias("csize")),
        F.struct(F.lit("words").alias("algo"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("double").alias("csize")),
        F.struct(F.lit("hex").alias("algo"), (2 * size).cast("double").alias("csize")),
    )
    return docs.select(F.col("doc_id").alias("file"), "lang", "source", size.alias("size"), F.explode(algos).alias("x")).select("file", "lang", "source", "size", "x.*")


@query
def bench_wide(spark, sf):
    return tables.pivot_benchmark(_results(spark, sf), ["chars", "hex", "words"])


@query
def bench_long(spark, sf):
    wide = bench_wide(spark, sf).withColumn("words", F.when(F.col("words") > 100, F.col("words").cast("string")).otherwise("ERROR: too short"))
    long = tables.unpivot_benchmark(wide.withColumn("chars", F.col("chars").cast("string")), "file", "size")
    return long.withColumn("bits_per_byte", F.round("bits_per_byte", 6))


@query
def best_algo(spark, sf):
    return R.flag_best(_results(spark, sf), "csize", "file").select("file", "algo", "csize", "best")


@query
def mean_effectiveness(spark, sf):
    return R.mean_effectiveness(_results(spark, sf)).select("algo", F.round("mean", 6).alias("mean"))


@query
def group_summary_rollup(spark, sf):
    rows = _results(spark, sf)
    groups = rows.select(F.col("lang").alias("grp"), "file").distinct()
    return R.group_summary(rows.drop("lang", "source"), groups).select("grp", "algo", F.round("mean", 6).alias("mean"))


@query
def autoscale(spark, sf):
    rows = _results(spark, sf).withColumn("r", F.col("csize") / F.nullif(F.col("size") - 85, F.lit(0)))
    return R.autoscale(rows.withColumn("r", F.coalesce("r", F.lit(float("inf")))), "r").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query
def params_consolidate(spark, sf):
    names = ["byte", "token"]
    found = {
        n: spark.createDataFrame(fixtures.PARAMETERS[n], "depth int, alpha double, beta double, mean_efficiency double") for n in names
    }
    return tables.consolidate(found)


@query
def params_argmin(spark, sf):
    wide = params_consolidate(spark, sf)
    long = tables.unpivot_parameters(wide, ["byte", "token"])
    best = R.best_by(long, "mean_efficiency", ["depth"], ["depth", "alpha", "beta"], "prior")
    return best.select("prior", "depth", "alpha", "beta", "mean_efficiency")


@query
def params_delta(spark, sf):
    """What parameters fitted on one half of the line items' flags lose on the other, by part size."""
    scores = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("prior"),
        F.when(F.col("l_quantity") < 25, "training").otherwise("test").alias("fitted_on"),
        F.when(F.col("l_linenumber") < 3, "training").otherwise("test").alias("depth_from"),
        F.col("l_discount").alias("score"),
    )
    out = R.transfer(scores)
    return out.select("prior", *(F.round(c, 6).alias(c) for c in ("total", "by_depth", "by_parameters")))


@query
def resource_mean_sem(spark, sf):
    out = R.mean_and_error(table(spark, sf, "events"), "value", "event_type")
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"))


@query
def efficiency_by_depth(spark, sf):
    params = spark.createDataFrame([(n, r[0]) for n, rows in fixtures.PARAMETERS.items() for r in rows], "prior string, depth int")
    scores = _results(spark, sf).select(
        F.col("lang").alias("set"), F.when(F.col("algo") == "hex", "byte").otherwise("token").alias("prior"),
        (F.col("file") % 10).cast("int").alias("depth"), (F.col("csize") / F.col("size") * 8).alias("efficiency"),
    )
    out = R.efficiency_by_depth(params, scores)
    return out.select("set", "prior", "depth", F.round("mean", 6).alias("mean"))


@query
def json_corpus(spark, sf):
    rows = _results(spark, sf)
    groups = rows.where("algo = 'hex'").select(F.concat("source", F.lit("/"), "lang").alias("corpus"), "file", F.col("file").alias("ord"))
    return tables.corpus_json(rows.select("file", "algo", "csize"), groups)


# --- corpus ----------------------------------------------------------------------------------


@query
def corpus_include_exclude(spark, sf):
    return corpus.include_exclude(table(spark, sf, "pages").select("page_id", "url"), "url", ["http*://*.example.org/*/*", "http://*.example.com/*"], ["*://blog.*/*/*"])


@query
def algo_regex_filter(spark, sf):
    names = spark.createDataFrame([(n,) for n in grid_names()], "algo string")
    return corpus.regex_filter(names, "algo", ["ppm[0-3]", "lzw", "none"], [".*_lzw_byte", "ppm.*uniform_token"])


@query
def work_grid(spark, sf):
    """Work items of every file by every algorithm, and their bytes, without scoring them: files are summed before they meet the names."""
    files = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("items"), F.sum(F.octet_length("text")).alias("bytes"))
    return files.select("lang", F.explode(F.array(*map(F.lit, grid_names()))).alias("algo"), "items", "bytes")


@query
def md5_topn_per_lang(spark, sf):
    return sampling.md5_top(documents(spark, sf), 5, "lang")


def _speakers(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("population"))


@query
def cumulative_population(spark, sf):
    return sampling.cumulative(_speakers(spark, sf), "population", ["source"])


@query
def pps_systematic_sample(spark, sf):
    return sampling.systematic(_speakers(spark, sf), "population", ["source"], 12)


@query
def language_subset(spark, sf):
    quota = sampling.systematic(table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("w")), "w", ["lang"], 20)
    return sampling.language_subset(documents(spark, sf), quota).select("lang", "doc_id", "digest", "rank")


@query
def pps_without_replacement(spark, sf):
    return sampling.proportional_without_replacement(_speakers(spark, sf), "population", 5, "source")


@query
def legal_param_grid(spark, sf):
    grid = search.alpha_beta_grid(spark, (-0.5, 1.0), (-0.25, 1.25), 13)
    return grid.select("id", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "legal")


@query
def file_sizes(spark, sf):
    docs = table(spark, sf, "documents")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select(
        "doc_id", size.alias("size"), F.log2(F.greatest(size, F.lit(1))).cast("int").alias("magnitude"), special.next_power(size).alias("next_power"),
        text.file_safe(F.concat_ws("/", "source", "lang")).alias("name"),
    )


@query
def longest_row_text(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", corpus.longest_row_text(F.regexp_replace("html", "li>", "tr>")).alias("row"))


@query
def line_counts(spark, sf):
    lines = corpus.line_items(documents(spark, sf), "text", "doc_id")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("item")).alias("longest"))


@query
def bit_counts(spark, sf):
    """Ones among the bits of documents."""
    docs = documents(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return corpus.bit_items(docs, "data", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_bits"), F.sum("item").cast("long").alias("ones"))


@query
def special_functions(spark, sf):
    x = (F.col("id") + 1) / 4.0
    rows = spark.range(200).select(x.alias("x"))
    x = F.col("x")
    return rows.select(
        "x", F.round(special.log_gamma(x), 6).alias("log_gamma"), F.round(special.log_beta(x, F.lit(2.5)), 6).alias("log_beta"),
        F.round(special.inverse_logit(x), 6).alias("inverse_logit"), F.round(special.log_sum_exp(F.array(x, x * 2, -x)), 6).alias("log_sum_exp"),
        F.round(special.log_choose(x + 3, F.lit(2.0)), 6).alias("log_choose"),
    )


@query
def distribution_masses(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 51.0).alias("x"), F.col("p_size").cast("double").alias("k"))
    x, k = F.col("x"), F.col("k")
    return parts.select(
        "p_partkey",
        F.round(D.binomial(k, F.lit(60.0), F.lit(0.4)), 6).alias("binomial"),
        F.round(D.beta(x, F.lit(2.0), F.lit(3.5)), 6).alias("beta"),
        F.round(D.gamma(k, F.lit(2.5), F.lit(4.0)), 6).alias("gamma"),
        F.round(D.gaussian(k, F.lit(25.0), F.lit(100.0)), 6).alias("gaussian"),
        F.round(D.mixture([1.0, 3.0], [F.exp(D.gaussian(k, F.lit(10.0), F.lit(25.0))), F.exp(D.gaussian(k, F.lit(40.0), F.lit(25.0)))]), 6).alias("mixture"),
    )


@query
def contour_grid(spark, sf):
    """PPM over all benchmark items for every cell of a grid: legal cells have a mean within bounds, illegal ones are infinite."""
    items = table(spark, sf, "benchmark").select(F.col("text").alias("content"))
    found = search.contour(spark, items, "uniform_byte", 2, (0.0, 0.5), (0.0, 0.9), 4)
    finite = F.col("efficiency") < float("inf")
    return found.select(
        "id", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), finite.alias("legal"), F.when(finite, F.col("efficiency").between(0.5, 9.0)).alias("inside")
    )


@query
def benchmark_grid(spark, sf):
    """Every benchmark item by every algorithm (those of the experiments, tuned ones and codecs), unpacked and compared."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("file"), F.col("text").alias("content"))
    done = experiments.benchmark(spark, items, parameters={"training": fixtures.tuned_rows()})
    good = (F.col("status") == "ok") & (F.col("csize") > 0) & (F.col("wall") < 600)
    return done.groupBy("algo").agg(F.count("*").alias("files"), F.count_if(good).alias("good"), F.sum("size").alias("bytes"))


@query
def resource_usage(spark, sf):
    """What packing documents takes, by algorithm, twice each: repetitions agree, and times and memory are positive."""
    docs = every_document(spark, sf).select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    done = materialise(score.grid(docs, ["ref_gzip", "ppm2_uniform_byte", "lzw_uniform_byte"], paranoid=True, replications=2, kernel=True), "grid")
    runs = R.collected(done, "csize", "algo", "status", "file", "size")
    sane = done.groupBy("algo").agg(F.bool_and((F.col("wall") > 0) & (F.col("cpu") >= 0) & (F.col("memory") > 0) & (F.col("grown") >= 0)).alias("sane"))
    same = runs.groupBy("algo", "status").agg(F.count("*").alias("files"), F.bool_and(F.size(F.array_distinct("values")) == 1).alias("steady"))
    return same.join(F.broadcast(sane), "algo")


@query
def bits_polya_stoken(spark, sf):
    """A Polya tree over simple tokens."""
    return A.total_bits(A.polya(A.characters(_short(spark, sf)), S.SIMPLE_RANGE))


@query
def bits_polya_random(spark, sf):
    """A Polya tree whose priors follow the masses of tokens under random bytes."""
    return A.total_bits(A.mass_polya(A.characters(_short(spark, sf)), S.SIMPLE_RANGE, A.random_bytes_between))


def _short(spark, sf) -> DataFrame:
    """Names of parts as texts: 21 levels of windows for each character."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))


@query
def bits_blending_matrix(spark, sf):
    """Blending with parameters by depth and fan-out."""
    alpha, beta = C.by_depth_and_fanout([[0.5, 0.4], [0.1, 0.2]]), C.by_depth_and_fanout([[0.7, 0.6, 0.5], [0.4, 0.3, 0.2]])
    return C.total_bits(documents(spark, sf), C.code_points, C.bits(C.blending(1, 1.0 / S.SIMPLE_RANGE, alpha, beta)))


@query
def int_items(spark, sf):
    """Lines that are integers: keys of line items, written as text."""
    texts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit(" "), "l_partkey"))), "\nno number\n").alias("text"))
    return corpus.int_items(texts, "text", "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("item").cast("long").alias("total"))


@query
def symbol_sampling(spark, sf):
    """Draws spread evenly over [0, 1) by the shares of languages: how many fall to each."""
    hist = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    draws = spark.range(1000).select(((F.col("id") + 0.5) / 1000).alias("u"))
    return sampling.categorical(draws, hist, "lang", "n").groupBy("lang").agg(F.count("*").alias("hits"))


@query
def collected_values(spark, sf):
    """Discounts of each order as a sorted list."""
    return R.collected(table(spark, sf, "lineitem"), "l_discount", "l_orderkey").select("l_orderkey", F.array_join(F.transform("values", lambda v: F.format_string("%.2f", v)), ",").alias("discounts"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in QUERIES}

