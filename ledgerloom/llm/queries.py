"""The operators as queries over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm import (
    ann,
    conversation_repair,
    exact_search,
    jaccard_join,
    licenses,
    lm,
    mixing,
    near_dedup,
    passages,
    pieces,
    sharding,
    spelling,
    toxicity,
)
from ledgerloom.llm.common import LOWER, UPPER, read, text_keys
from ledgerloom.llm.vectors import usable
from ledgerloom.session import materialise

SHARDS = 40
RAKED = ["source", "lang", "topic"]
SOURCE_TEMPER, LANG_TEMPER, TOPIC_TEMPER = 0.7, 0.8, 0.9
MIX_SEED = 17
TOXIC = 0.7
EXACT_K = 5
NEAREST = 20
SLIPS = 199  # every so many runs of letters lose one of them
PIECES = os.environ.get("PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf, "documents"))


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf, "documents"), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_ann(spark: SparkSession, sf: str) -> DataFrame:
    vectors = materialise(
        usable(read(spark, sf, "embeddings"), "vec_id", F.col("embedding"), zero=False)
    )
    return ann.nearest_neighbours(vectors, vectors.filter(F.col("id") % 20 == 0), NEAREST)


def op4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    vocabulary = pieces.load_vocabulary(PIECES)
    return pieces.encode_pieces(docs, vocabulary, check=True).select(
        "doc_id", "n_pieces", "ids", "exact"
    )


def op5_lm(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm.score_texts(read(spark, sf, "documents"), ~held_out).select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_keys(read(spark, sf, "documents").select("doc_id", "text"))
    found = passages.near_passages(docs, "_key")
    further = docs.filter("_key <> doc_id").select(F.col("_key").alias("a"), F.col("doc_id").alias("_a"))
    found = found.join(further.distinct(), "a", "left").withColumn("a", F.coalesce("_a", "a")).drop("_a")
    found = materialise(found)
    spans = passages.repeated_spans(found).withColumnRenamed("id", "_key")
    copied = found.groupBy(F.col("a").alias("doc_id")).agg(
        F.count_distinct("b").alias("n_copied_by")
    )
    return (
        docs.select("doc_id", "_key")
        .join(spans, "_key", "left")
        .join(copied, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
            "spans",
            "first_docs",
            F.coalesce("n_copied_by", F.lit(0)).alias("n_copied_by"),
        )
    )


def op7_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    kept = usable(read(spark, sf, "embeddings"), "vec_id", F.col("embedding"))
    vectors = kept.select("id", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))
    found = exact_search.exact_top_k(vectors, vectors.filter(F.col("id") % 50 == 0), EXACT_K)
    return found.withColumn("score", F.col("score").cast("long"))


def topic_of(text: Column) -> Column:
    """Layout of a text as its topic: table, marked (words run into signs), brief or prose."""
    return (
        F.when(F.instr(text, " | ") > 0, "table")
        .when((F.instr(text, "###") > 0) | (F.instr(text, "$$$") > 0), "marked")
        .when(F.length(text) < 600, "brief")
        .otherwise("prose")
    )


def mixed(docs: DataFrame, keep: float = 1.0) -> DataFrame:
    """docs with topic, tokens and the columns of mix_sources, at the weights used here."""
    sized = docs.withColumns(
        {
            "topic": topic_of(F.coalesce("text", F.lit(""))),
            "tokens": mixing.word_count(F.col("text")),
        }
    )
    cells = materialise(mixing.cell_table(sized, RAKED))
    tempers = dict(zip(RAKED, (SOURCE_TEMPER, LANG_TEMPER, TOPIC_TEMPER), strict=True))
    targets = {c: mixing.tempered(cells, c, e) for c, e in tempers.items()}
    return mixing.mix_sources(sized, RAKED, targets, cells, keep=keep, seed=MIX_SEED)


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return mixed(docs).select(
        "doc_id",
        "source",
        "lang",
        "topic",
        "tokens",
        F.round("factor", 6).alias("factor"),
        F.round("probability", 6).alias("probability"),
        "copies",
    )


def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text", "matches")


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    # rows without an id have no labels and are not held out
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    taught = read(spark, sf, "labels").filter(~held_out)
    model = toxicity.fit_toxicity(docs, taught)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= TOXIC, 1).otherwise(0).alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op11_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with the damage that their conversation and turn decide."""

    def shown(column):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = shown("text")
    return (
        rows.select(
            "conv_id",
            "turn",
            F.when(fate == 4, "user").otherwise(shown("role")).alias("role"),
            F.when(fate == 1, "")
            .when(fate == 2, F.regexp_replace(text, "[.!?]", ""))
            .otherwise(text)
            .alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1))).alias("_"),
        )
        .drop("_")
    )


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations")
    repaired = conversation_repair.repair_conversations(damaged(rows)).withColumnRenamed("conv_id", "_c")
    zeros = [
        F.coalesce(c, F.lit(0).cast("long")).alias(c)
        for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ]
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return every.join(repaired, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        "conv_id",
        *zeros,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.vocabulary(read(spark, sf, "documents"), slips=SLIPS)
    return spelling.spelling_variants(words)


def _exact_topk_sql() -> str:
    return f"""
        WITH kept AS (
          SELECT vec_id, list_transform(embedding,
              lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM kept q JOIN kept c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
            AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {EXACT_K}"""


def _licenses_sql() -> str:
    phrases = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        phrases.append(
            f"list_transform(list_filter(range(len(w)), lambda i: {same}),"
            f" lambda i: {{'at': i, 'label': '{label}'}})"
        )
    labels = ", ".join(
        "CASE WHEN "
        + " OR ".join(f"regexp_matches(line, ' {licenses.pattern(t)}')" for t in several)
        + f" THEN '{label}' END"
        for label, several in licenses.TEMPLATES.items()
    )
    return rf"""
        WITH worded AS (
          SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        lined AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line,
                    {" || ".join(phrases)} AS base FROM worded),
        marked AS (SELECT *,
            list_distinct(list_transform(base, lambda x: x.label)) AS b,
            list_filter([{labels}], lambda x: x IS NOT NULL) AS t FROM lined)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base,
          CAST(list_min(list_transform(base, lambda x: x.at)) AS BIGINT) AS first_word,
          CAST(list_max(list_transform(base, lambda x: x.at)) AS BIGINT) AS last_word,
          coalesce(array_to_string(list_sort(b), ','), '') AS base_labels,
          coalesce(array_to_string(list_sort(b || t), ','), '') AS labels,
          1 - pow(0.5, len(b)) * pow(0.2, len(t)) AS score
        FROM marked"""


def _mixing_sql(sweeps: int = 40) -> str:
    """The same sweeps, unrolled over the few cells."""
    steps = [
        r"""
        WITH sized AS (
          SELECT doc_id, source, lang,
            CASE WHEN instr(coalesce(text, ''), ' | ') > 0 THEN 'table'
                 WHEN instr(coalesce(text, ''), '###') > 0 OR instr(coalesce(text, ''), '$$$') > 0
                 THEN 'marked'
                 WHEN length(coalesce(text, '')) < 600 THEN 'brief' ELSE 'prose' END AS topic,
            CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)
              AS tokens
          FROM documents),
        w0 AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens,
                      CAST(sum(tokens) AS DOUBLE) / sum(sum(tokens)) OVER () AS weight
               FROM sized GROUP BY ALL)"""
    ]
    tempers = dict(zip(RAKED, (SOURCE_TEMPER, LANG_TEMPER, TOPIC_TEMPER), strict=True))
    for column, exponent in tempers.items():
        steps.append(
            f"t_{column} AS (SELECT {column}, pow(sum(tokens), {exponent}) AS raw,"
            f" pow(sum(tokens), {exponent}) / sum(pow(sum(tokens), {exponent})) OVER () AS share"
            f" FROM w0 GROUP BY {column})"
        )
    last = "w0"
    for n in range(sweeps):
        for column in RAKED:
            name = f"w{n}_{column}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, tokens,"
                f" weight * share / sum(weight) OVER (PARTITION BY w.{column}) AS weight"
                f" FROM {last} w JOIN t_{column} t ON w.{column} = t.{column})"
            )
            last = name
    steps.append(
        f"done AS (SELECT source, lang, topic,"
        f" weight * sum(tokens) OVER () / tokens AS factor FROM {last})"
    )
    return (
        ",\n".join(steps)
        + f"""
        SELECT doc_id, s.source, s.lang, s.topic, s.tokens, round(factor, 6) AS factor,
          round(least(1.0, factor), 6) AS probability,
          CAST(floor(factor) + CASE WHEN
            CAST('0x' || substr(md5('{MIX_SEED}/' || doc_id), 1, 8) AS BIGINT) / 4294967296.0
            < factor - floor(factor) THEN 1 ELSE 0 END AS INTEGER) AS copies
        FROM sized s JOIN done d ON s.source = d.source AND s.lang = d.lang AND s.topic = d.topic"""
    )


#: The 256 remainders of the CRC-32 polynomial, worked out in SQL.
_CRC_TABLE = """
        crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
          lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text; needs the row of `crc` beside it."""
    found = f"regexp_extract_all(hex(encode({text})), '..')"
    byte_list = f"list_transform({found}, lambda x: CAST('0x' || x AS BIGINT))"
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte_list}),"
        " lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"
    )


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def _sharding_sql() -> str:
    return f"""
        WITH {_CRC_TABLE},
        sized AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + {sharding.ROW_BYTES} AS size,
            {_crc_sql("text")} AS text_crc32 FROM documents, crc),
        lined AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32) AS upto,
            sum(size) OVER () AS total FROM sized),
        cut AS (SELECT *, CAST(least({SHARDS - 1}, (2 * upto - size) * {SHARDS} // (2 * total)) AS INTEGER)
            AS shard FROM lined)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
          row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot,
          CAST(NULL AS INTEGER) AS grown_shard FROM cut"""


def _linked_sql(percent: int) -> str:
    """Shingle sets, links between documents and the smallest document each one reaches."""
    return rf"""
        WITH RECURSIVE worded AS (
          SELECT doc_id, regexp_extract_all({_lowered("text")}, '[^ 	-
]+') AS w FROM documents),
        shingled AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)),
            lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM worded WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
        met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
          FROM shingled x JOIN shingled y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM met JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
          WHERE 100 * common >= {percent} * (p.n + q.n - common)),
        reached AS (SELECT a, b FROM links UNION
          SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
        lowest AS (SELECT a AS doc_id, min(b) AS least_id FROM reached GROUP BY a),
        linked AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a),
        found AS (SELECT d.doc_id, coalesce(n, 0) AS n_shingles,
            least(d.doc_id, coalesce(least_id, d.doc_id)) AS component_id,
            coalesce(n_links, 0) AS n_links
          FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
          LEFT JOIN linked USING (doc_id))"""


def _spelling_sql() -> str:
    cut = "substr(w, 1, k) || substr(w, k + 2)"
    return f"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
            unnest(regexp_extract_all({_lowered("text")}, '{spelling.RUNS}')) AS w FROM documents),
        counted AS (SELECT id, w, count(*) AS m FROM runs GROUP BY ALL),
        summed AS (SELECT w, m, {_crc_sql("id || ':' || w")} AS h FROM counted, crc),
        slipped AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN {cut} ELSE w END AS word, m
          FROM (SELECT *, CAST(h % length(w) AS INTEGER) AS k FROM summed)),
        words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM slipped GROUP BY word
          HAVING length(word) >= {spelling.SHORTEST} AND sum(m) >= {spelling.LEAST}),
        less AS (SELECT DISTINCT word, i AS place, substr(word, 1, i) || substr(word, i + 2) AS rest
          FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
        near AS (
          SELECT a.word, b.word AS other FROM less a JOIN less b
            ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
          UNION SELECT less.word, words.word FROM less JOIN words ON less.rest = words.word
          UNION SELECT words.word, less.word FROM less JOIN words ON less.rest = words.word),
        best AS (SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near
          FROM near JOIN words ON other = words.word
          QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) = 1),
        forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
            CASE WHEN best.n >= {spelling.LEAST} * words.n THEN other END AS form,
            CASE WHEN best.n >= {spelling.LEAST} * words.n THEN best.n END AS form_n
          FROM words LEFT JOIN best USING (word)),
        way AS (SELECT word, word AS last, 0 AS steps FROM words UNION ALL
          SELECT way.word, form, steps + 1 FROM way JOIN forms ON way.last = forms.word WHERE form IS NOT NULL)
        SELECT forms.word, form, root, n, n_near, form_n FROM forms
        JOIN (SELECT word, arg_max(last, steps) AS root FROM way GROUP BY word) r ON forms.word = r.word"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_sharding": op2_sharding,
        "op3_ann": op3_ann,
        "op4_pieces": op4_pieces,
        "op5_lm": op5_lm,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_exact_topk": op7_exact_topk,
        "op8_mixing": op8_mixing,
        "op9_licenses": op9_licenses,
        "op10_toxicity": op10_toxicity,
        "op11_jaccard_join": op11_jaccard_join,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": _linked_sql(75)
        + " SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM found",
        "op2_sharding": _sharding_sql(),
        "op7_exact_topk": _exact_topk_sql(),
        "op8_mixing": _mixing_sql(),
        "op9_licenses": _licenses_sql(),
        "op11_jaccard_join": _linked_sql(80) + " SELECT * FROM found",
        "op13_spelling_variants": _spelling_sql(),
    }
