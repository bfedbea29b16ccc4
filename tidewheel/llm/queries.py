"""The contract queries over the generated tables, and their SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.wrappers import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.jaccard_join import join

    return join(table(spark, sf_dir, "documents"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.spotsigs import fingerprint

    return fingerprint(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.shared import scratch
    from tidewheel.llm.token_files import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "ids"), tokenizer_path())
    return read_token_files(spark, manifest)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.chat import added_turns, format_and_read

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_and_read(turns.unionByName(added_turns(spark)))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.quality import fit, score, statistics
    from tidewheel.llm.shared import materialise

    stats = materialise(statistics(table(spark, sf_dir, "documents")), "statistics")
    return score(stats, fit(stats, table(spark, sf_dir, "labels")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewheel.llm.whitening import fit, whiten

    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_spotsigs": op7_spotsigs,
    "op8_sharding": op8_sharding,
    "op9_token_files": op9_token_files,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_quality": op11_quality,
    "op12_divergence": op12_divergence,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op3_decontamination": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS words
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM win),
        dwin AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
                 FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
        hit AS (SELECT doc_id, i, d.size, item_id FROM dwin d JOIN win USING (size, words)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    # No SQL: op1, op9 (a tokenizer), op8 (a hash SQL does not share), op11 (a trained model), op13 (eigenvectors); tests/llm holds them against brute force.
    "op10_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, length('<s>[INST ' || role || ']' || chr(10))
                + length(regexp_replace(replace(text, '\', '\\'), '<s>|</s>|\[INST|\[/INST|<<SYS>>|<</SYS>>', 'x\0', 'g'))
                + length('[/INST]</s>' || chr(10)) AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
        FROM e GROUP BY conv_id""",
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
        own AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
        grp AS (SELECT lang, source, coalesce(any_value(total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
                LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own GROUP BY lang, source) USING (lang, source) GROUP BY lang, source),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
                  CAST(1 + (1000000000 * (CAST(coalesce(o.n, 0) AS HUGEINT) + 5)) // (CAST(g.total AS HUGEINT) + 5 * v.v) AS BIGINT) AS p,
                  CAST(1 + (1000000000 * (CAST(k.n AS HUGEINT) + 5)) // (CAST(v.total AS HUGEINT) + 5 * v.v) AS BIGINT) AS q
              FROM grp g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(any_value(f), 0) AS BIGINT) AS value
                  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
                    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                  GROUP BY a.lang, a.source, b.source),
        alls AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM alls)
        WHERE part = 'pair' OR rank <= 50""",
}
