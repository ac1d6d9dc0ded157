"""The corpus operators as registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import bpe_round_trip
from lodestone.llm.common import load
from lodestone.llm.exact_dedup import exact_groups
from lodestone.llm.fim import fill_in_middle
from lodestone.llm.fingerprints import neighbour_fingerprints
from lodestone.llm.jaccard_join import jaccard_components
from lodestone.llm.lm import language_model_scores
from lodestone.llm.merkle import merkle_manifest
from lodestone.llm.mixing import DIMENSIONS, FLATTEN, FRACTION, LEAST, ROUNDS, shares, with_probabilities
from lodestone.llm.pii import KINDS, find_personal_data
from lodestone.llm.secrets import find_secrets
from lodestone.llm.substring_dedup import duplicate_spans
from lodestone.llm.toxicity import THRESHOLD, fitted_on, held_out, score_toxicity
from lodestone.llm.warc import archive_folder, read_bundles, write_bundles


def vocabulary() -> str:
    """Where the installed public byte-level vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span that repeats what a document with a smaller id has in one piece, in code points."""
    return duplicate_spans(load(spark, sf_dir, "documents")).select("doc_id", "start", "end", "n_chunks", "first_id", "first_start")


def _joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and digest of the base findings, and all spans."""
    found = find_secrets(load(spark, sf_dir, "documents"))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "learned")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        of("learned").alias("n_learned"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of the base findings, and all spans."""
    found = find_personal_data(load(spark, sf_dir, "documents"))

    def of(column: str, kind: str) -> Column:
        return F.filter(column, lambda s: s["kind"] == kind)

    both = F.concat(*[F.array_sort(F.concat(of("base", k), of("found", k))) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(of("base", k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(both).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, multiplier, probability and whether it is sampled."""
    mixed = with_probabilities(load(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"), "source", "lang", "topic", "tokens",
        F.round("multiplier", 6).alias("multiplier"), F.round("prob", 6).alias("prob"), "sampled",
    )


def op4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name's target and expected share, and the share of all tokens that is expected."""
    rounded = [F.round(c, 6).alias(c) for c in ("target", "expected", "residual", "fraction")]
    return shares(load(spark, sf_dir, "documents")).select("dimension", "name", *rounded)


def _op4_ctes() -> str:
    """The same raking, all its rounds unrolled: first without bounds, then, for where it is needed, with them."""
    parts = [
        r"""
k AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
    CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, ' = ') THEN 'config' WHEN contains(t, '@') THEN 'contact'
      WHEN contains(t, 'icense') THEN 'licensed' WHEN length(t) < 400 THEN 'short' ELSE 'prose' END AS topic,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
),
c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS mass FROM k GROUP BY ALL),
total AS (SELECT sum(mass) AS total FROM c)"""
    ]
    for d in DIMENSIONS:
        parts.append(
            f"s_{d} AS (SELECT {d}, r / sum(r) OVER () AS share FROM "
            f"(SELECT {d}, CASE WHEN sum(mass) > 0 THEN pow(sum(mass), {FLATTEN[d]}) ELSE 0 END AS r FROM c GROUP BY {d}))"
        )
    for w, bound in (("w", ""), ("b", f", mass / {LEAST}")):
        parts.append(f"{w}0 AS MATERIALIZED (SELECT *, mass AS weight FROM c)")
        n = 0
        for _ in range(ROUNDS):
            for d in DIMENSIONS:
                parts.append(
                    f"{w}{n + 1} AS MATERIALIZED (SELECT {w}{n}.source, {w}{n}.lang, {w}{n}.topic, mass, CASE WHEN m.s > 0 THEN "
                    f"least(weight * (share * (SELECT total FROM total) / m.s){bound}) ELSE 0 END AS weight FROM {w}{n} "
                    f"JOIN (SELECT {d}, sum(weight) AS s FROM {w}{n} GROUP BY {d}) m USING ({d}) JOIN s_{d} USING ({d}))"
                )
                n += 1
    parts.append(
        f"""free AS (SELECT least({FRACTION}, 1 / max(weight / mass)) AS x FROM w{n} WHERE mass > 0),
f AS (SELECT w.source, w.lang, w.topic, mass, CASE WHEN mass > 0 THEN (CASE WHEN (SELECT x FROM free) < {LEAST} THEN b.weight ELSE w.weight END) / mass ELSE 0 END AS m
  FROM w{n} w JOIN (SELECT source, lang, topic, weight FROM b{n}) b USING (source, lang, topic)),
scale AS (SELECT greatest(x, {LEAST}) AS x FROM free),
p AS (SELECT *, least(1.0, m * (SELECT x FROM scale)) AS prob FROM f)"""
    )
    return "WITH " + ",\n".join(part.strip() for part in parts)


def op4_sql() -> str:
    return (
        _op4_ctes()
        + """
SELECT k.doc_id, k.source, k.lang, k.topic, k.tokens, round(m, 6) AS multiplier, round(prob, 6) AS prob,
  ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < prob AS sampled
FROM k JOIN p USING (source, lang, topic)"""
    )


def op4_shares_sql() -> str:
    names = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS name, any_value(share) AS target, sum(mass * prob) / (SELECT sum(mass * prob) FROM p) AS expected FROM p JOIN s_{d} USING ({d}) GROUP BY {d}"
        for d in DIMENSIONS
    )
    return (
        _op4_ctes()
        + f"""
SELECT dimension, name, round(target, 6) AS target, round(expected, 6) AS expected, round(expected - target, 6) AS residual,
  (SELECT round(sum(mass * prob) / sum(mass), 6) FROM p) AS fraction FROM ({names})"""
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the written archive."""
    index = write_bundles(load(spark, sf_dir, "pages"), archive_folder(spark))
    return read_bundles(index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '')
    AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle set size and the smallest document that links reach."""
    return jaccard_components(load(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.reached = p.a
)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(reached) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, sh
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the network fitted on the labels that are not held out."""
    docs = load(spark, sf_dir, "documents")
    network = fitted_on(docs, load(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), network, score_col="score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, compared with its edited text's and its neighbour's."""
    return neighbour_fingerprints(load(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, and digests of its ids and of the decoded text."""
    return bpe_round_trip(load(spark, sf_dir, "documents"), vocabulary()).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of the copy that stays."""
    return exact_groups(load(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, lengths of its pieces, and digests of the output and of the restored text."""
    cut = fill_in_middle(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1 : least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS mid,
  array_to_string(u[greatest(a, b) + 1 : n], '') AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and the root that folding a tampered text gives."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(changed, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle_manifest(load(spark, sf_dir, "documents"), {"text": tampered}).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


def op12_sql(levels: int = 12) -> str:
    """The same tree by grouping level by level, unrolled; up to 3^``levels`` documents a source."""

    def sized(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    head = "sha256(" + " || ".join(sized(f) for f in ("doc_id", "source", "lang", "n_chars")) + " || "
    parts = [
        f"""d AS (
  SELECT doc_id, source, {head}{sized("text")}) AS leaf, CASE WHEN crc & 1 = 0 THEN {head}{sized("replace(text, chr(10), '')")}) ELSE leaf END AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
  FROM (SELECT *, xor(4294967295, list_reduce(list_transform(range(0, 8 * length(doc_id::VARCHAR)),
    lambda i: ((ord((doc_id::VARCHAR)[(i // 8) + 1]) >> (i % 8)) & 1)::BIGINT),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT)) AS crc FROM documents)
)"""
    ]

    def climb(name: str, base: str) -> None:
        """``<name>_nodes``: the node of each level that has a parent, ``<name>_top``; ``base``: ``g, pos, digest``."""
        parts.append(f"{name}0 AS (SELECT g, pos, digest, count(*) OVER (PARTITION BY g) AS n FROM ({base}))")
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS (SELECT g, pos, digest, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, pos // 3 AS pos, "
                f"CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}{k} GROUP BY g, pos // 3))"
            )

    def fold(name: str, rows: str) -> str:
        """The name of rows with ``proof`` and ``f`` carried up all levels of ``name``; ``rows`` has ``g, pos``."""
        for k in range(levels):
            parts.append(
                f"{name}_runs{k} AS (SELECT g, pos // 3 AS p, list(digest ORDER BY pos) AS ds FROM {name}{k} WHERE n > 1 GROUP BY ALL)"
            )
            parts.append(
                f"{name}_up{k} AS (SELECT r.* EXCLUDE (pos, proof, f), r.pos // 3 AS pos, "
                f"proof || CASE WHEN ds IS NULL THEN '' ELSE array_to_string(list_filter(ds, lambda x, i: i <> r.pos % 3 + 1), '') END AS proof, "
                f"CASE WHEN ds IS NULL THEN f ELSE sha256(array_to_string(list_transform(ds, lambda x, i: CASE WHEN i = r.pos % 3 + 1 THEN f ELSE x END), '')) END AS f "
                f"FROM {rows} r LEFT JOIN {name}_runs{k} u ON u.g IS NOT DISTINCT FROM r.g AND u.p = r.pos // 3)"
            )
            rows = f"{name}_up{k}"
        return rows

    climb("t", "SELECT source AS g, pos, leaf AS digest FROM d")
    parts.append(f"sub AS (SELECT g AS source, digest AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS spos FROM t{levels})")
    climb("s", "SELECT 0 AS g, spos AS pos, subroot AS digest FROM sub")
    parts.append("r0 AS (SELECT doc_id, leaf, source AS g, pos, '' AS proof, changed AS f FROM d)")
    low = fold("t", "r0")
    parts.append(f"r1 AS (SELECT doc_id, leaf, subroot, 0 AS g, spos AS pos, proof, f FROM {low} r JOIN sub ON sub.source IS NOT DISTINCT FROM r.g)")
    high = fold("s", "r1")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = digest AS verified FROM {high}, (SELECT digest FROM s{levels})"""
    )


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10-probability by the network and by smoothed counts of all training documents."""
    return language_model_scores(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_secrets": op2_secrets,
        "op3_pii": op3_pii,
        "op4_mixing": op4_mixing,
        "op4_shares": op4_shares,
        "op5_warc": op5_warc,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_toxicity": op7_toxicity,
        "op8_fingerprints": op8_fingerprints,
        "op9_bpe": op9_bpe,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_fim": op11_fim,
        "op12_merkle": op12_merkle,
        "op13_lm": op13_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": op4_sql(),
        "op4_shares": op4_shares_sql(),
        "op5_warc": OP5_SQL,
        "op6_jaccard_join": OP6_SQL,
        "op10_exact_dedup": OP10_SQL,
        "op11_fim": OP11_SQL,
        "op12_merkle": op12_sql(),
    }
