"""The registered queries of the numbered operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import damage, repair_conversations
from .exact_dedup import exact_groups
from .jaccard_join import jaccard_components
from .licences import BETWEEN, COPYRIGHT, KNOWN, SPELLINGS, VERSION, license_scan
from .line_labels import fit_line_labels, quality_rules
from .merkle_manifest import manifest_audit
from .mixing import mix_copies
from .packing import pack_best_fit
from .quality import fit_quality, quality_scores
from .session import cut
from .simhash import simhash_components
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .warc_audit import archive_index, damaged_copy, leaves, merkle_audit, record_digests, response_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    sound = cut(record_digests(response_records(pages)))
    index = cut(archive_index(sound))
    return merkle_audit(leaves(index, sound), leaves(index, record_digests(response_records(damaged_copy(pages)))))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_copies(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_line_labels(docs, table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_audit(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_license_scan, op3_warc_audit, op4_exact_dedup, op5_mix_sources, op6_suffix_dedup, op7_quality_rules, op8_token_counts, op9_jaccard_join, op10_best_fit_packing,
        op11_simhash_bk_trees, op12_merkle_manifest, op13_conversation_repair,
    )
}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licences_sql() -> str:
    spelled = f"regexp_replace(t, {_literal(VERSION)}, ' version  \\1', 'g')"
    for old, new in SPELLINGS:
        spelled = f"replace({spelled}, ' {old} ', ' {new.replace(' ', '  ')} ')"
    known = ", ".join(f"({_literal(name)}, {_literal(text)})" for name, text in KNOWN)
    return f"""
        WITH known AS (SELECT 'k' || row_number() OVER () AS id, name, text FROM (VALUES {known}) v(name, text)),
        texts AS (
            SELECT 'd' || row_number() OVER () AS id, doc_id, NULL AS name, coalesce(text, '') AS t FROM documents
            UNION ALL SELECT id, NULL, name, text FROM known),
        plain AS (SELECT id, doc_id, name, regexp_replace(lower(t), {_literal(COPYRIGHT)}, '', 'g') AS t FROM texts),
        spaced AS (SELECT id, doc_id, name, ' ' || replace(regexp_replace(t, {_literal(BETWEEN)}, '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' ' AS t FROM plain),
        spelled AS (SELECT id, doc_id, name, regexp_replace({spelled}, ' +', ' ', 'g') AS t FROM spaced),
        lines AS (SELECT id, doc_id, name, [trim(x, ' ') for x in string_split(t, chr(10)) if trim(x, ' ') <> ''] AS l FROM spelled),
        digests AS (SELECT id, doc_id, name, l, sha256(coalesce(array_to_string(l, ' '), '')) AS text_digest FROM lines),
        licences AS (SELECT text_digest AS digest, min(name) AS license_id FROM digests WHERE name IS NOT NULL GROUP BY text_digest),
        hits AS (
            SELECT id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(*) AS n
            FROM (SELECT id, sha256(unnest(l)) AS digest FROM digests WHERE name IS NULL) x JOIN licences USING (digest) GROUP BY id)
        SELECT doc_id, text_digest, license_id, coalesce(ids, '') AS line_license_ids, coalesce(n, 0) AS n_license_lines
        FROM digests LEFT JOIN licences ON text_digest = digest LEFT JOIN hits USING (id) WHERE name IS NULL"""


def _mixing_sql(sections: int = 512, steps: int = 5) -> str:
    """The same brackets as temperature_weights(), step by step."""
    parts = []
    for kind, last in (("even", "b0"), ("allowed", "b0")):
        for step in range(1, steps + 1):
            before = "start" if step == 1 and kind == "even" else "even_done" if step == 1 else f"{kind}_{step - 1}"
            parts.append(f"""
        {kind}_grid_{step} AS (SELECT k, low + (high - low) * k / {sections} AS a FROM {before}, range({sections + 1}) t(k)),
        {kind}_all_{step} AS (
            SELECT k, a, ln(z) - qlq / z >= 0.9999 * ln(n) - 1e-12 AS even, most / least <= 4.0 + 1e-12 AS allowed FROM (
                SELECT k, a, sum(pow(share, a)) AS z, sum(pow(share, a) * ln(pow(share, a))) AS qlq, count(*) AS n,
                       max(pow(share, a) / share) AS most, min(pow(share, a) / share) AS least
                FROM {kind}_grid_{step}, shares GROUP BY k, a) x),
        {kind}_at_{step} AS (SELECT {"coalesce(max(k) FILTER (even), 0)" if kind == "even" else f"coalesce(min(k) FILTER (allowed), {sections})"} AS pos FROM {kind}_all_{step}),
        {kind}_{step} AS (
            SELECT max(a) FILTER (k = {"pos" if kind == "even" else "greatest(pos - 1, 0)"}) AS low,
                   max(a) FILTER (k = {f"least(pos + 1, {sections})" if kind == "even" else "pos"}) AS high FROM {kind}_all_{step}, {kind}_at_{step})""")
        if kind == "even":
            parts.append(f"""
        even_done AS (SELECT low, 1.0::DOUBLE AS high FROM even_{steps})""")
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
        WITH docs AS (
            SELECT doc_id, source, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS n_tokens,
                   {number.format("'7:' || doc_id")} AS number FROM documents),
        sources AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY source),
        shares AS (SELECT *, tokens / CAST((SELECT sum(tokens) FROM sources) AS DOUBLE) AS share FROM sources),
        start AS (SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high),{",".join(parts)},
        powers AS (SELECT *, pow(share, (SELECT high FROM allowed_{steps})) AS q FROM shares),
        weights AS (SELECT *, q / (SELECT sum(q) FROM powers) AS weight FROM powers),
        budgets AS (SELECT *, weight * (SELECT max(tokens / weight) FROM weights) AS budget FROM weights),
        plan AS (
            SELECT *, CAST(floor(budget / tokens + 1e-9) AS BIGINT) AS times, CAST(ceil(tokens / 1048576.0) AS BIGINT) AS blocks FROM budgets),
        dealt AS (SELECT d.*, weight, times, number % blocks AS block, budget - times * tokens AS rest FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
        per_block AS (
            SELECT source, block, sum(n_tokens) AS tokens, any_value(rest) AS rest,
                   {number.format("'7:' || coalesce(source, 'null') || ':' || block || ':' || any_value(times)")} AS spot FROM dealt GROUP BY source, block),
        lefts AS (SELECT source, block, tokens, rest - (sum(tokens) OVER (PARTITION BY source ORDER BY spot, block) - tokens) AS room FROM per_block),
        runs AS (
            SELECT d.*, room, tokens, sum(n_tokens) OVER (PARTITION BY d.source, d.block ORDER BY number) AS run
            FROM dealt d JOIN lefts l ON d.source IS NOT DISTINCT FROM l.source AND d.block = l.block)
        SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, block,
               times + CASE WHEN room <= 0 THEN 0 WHEN room >= tokens OR run <= room + 1e-6 THEN 1 ELSE 0 END AS copies
        FROM runs"""


#: A node is hashed with its run until its source, then the whole table, has one left; paths and folds go level by level.
_MANIFEST_SQL = r"""
        WITH RECURSIVE fields AS (
            SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
            FROM documents),
        leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, head, text FROM fields),
        placed AS (SELECT *, coalesce('1' || source, '0') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
        low(level, grp, idx, h, n) AS (
            SELECT 0, grp, idx, leaf, count(*) OVER (PARTITION BY grp) FROM placed
            UNION ALL
            SELECT level + 1, grp, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY level, grp, idx // 3),
        subroots AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
        high(level, idx, h, n) AS (
            SELECT 0, idx, subroot, n FROM subroots
            UNION ALL
            SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY level, idx // 3),
        tree AS (
            SELECT level, grp, idx, h FROM low WHERE n > 1
            UNION ALL SELECT 1000 + level, '', idx, h FROM high WHERE n > 1),
        runs AS (SELECT level, grp, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM tree GROUP BY ALL),
        spots AS (
            SELECT p.*, s.subroot, s.idx AS top FROM placed p JOIN subroots s USING (grp)),
        steps AS (
            SELECT s.grp, s.idx AS leaf_idx, r.level, hs, CAST(s.idx // CAST(pow(3, r.level) AS BIGINT) % 3 AS BIGINT) AS slot
            FROM spots s JOIN runs r ON r.grp = s.grp AND r.run = s.idx // CAST(pow(3, r.level + 1) AS BIGINT)
            UNION ALL
            SELECT s.grp, s.idx, r.level, hs, CAST(s.top // CAST(pow(3, r.level - 1000) AS BIGINT) % 3 AS BIGINT)
            FROM spots s JOIN runs r ON r.grp = '' AND r.run = s.top // CAST(pow(3, r.level - 999) AS BIGINT)),
        numbered AS (
            SELECT *, array_to_string(hs[1:slot], '') AS before, array_to_string(hs[slot + 2:], '') AS after,
                   row_number() OVER (PARTITION BY grp, leaf_idx ORDER BY level) AS step FROM steps),
        proofs AS (SELECT grp, leaf_idx AS idx, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM numbered GROUP BY ALL),
        crc(doc_id, k, c) AS (
            SELECT DISTINCT doc_id, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
            UNION ALL
            SELECT doc_id, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END FROM (
                SELECT doc_id, k, CASE WHEN k % 8 = 0 THEN xor(c, ord(substr(doc_id::VARCHAR, k // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * strlen(doc_id::VARCHAR)) y),
        even AS (SELECT doc_id, xor(c, 4294967295::BIGINT) % 2 = 0 AS tampered FROM crc WHERE k = 8 * strlen(doc_id::VARCHAR)),
        met AS (
            SELECT s.*, CASE WHEN tampered THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE leaf END AS altered
            FROM spots s LEFT JOIN even USING (doc_id)),
        folds(grp, idx, step, h) AS (
            SELECT grp, idx, 1, altered FROM met
            UNION ALL
            SELECT f.grp, f.idx, f.step + 1, sha256(before || h || after) FROM folds f JOIN numbered n ON n.grp = f.grp AND n.leaf_idx = f.idx AND n.step = f.step),
        ends AS (SELECT grp, idx, arg_max(h, step) AS folded_root FROM folds GROUP BY ALL)
        SELECT m.doc_id, m.leaf, m.subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM met m LEFT JOIN proofs USING (grp, idx) JOIN ends USING (grp, idx), (SELECT h AS root FROM high WHERE n = 1) r"""

ORACLES = {
    "op12_merkle_manifest": _MANIFEST_SQL,
    "op2_license_scan": _licences_sql(),
    "op5_mix_sources": _mixing_sql(),
    "op3_warc_audit": """
        WITH r AS (
            SELECT page_id AS record_id, (page_id * 31) % 211 AS fate,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
                   || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
                   || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap, html
            FROM pages),
        s AS (
            SELECT record_id, fate, head || strlen(html) || gap || html || gap AS one,
                   head || strlen(lower(html)) || gap || lower(html) || gap AS two FROM r),
        p AS (SELECT *, (record_id * 7919) % (SELECT greatest(4, CAST(ceil(sum(strlen(one)) / 67108864) AS BIGINT)) FROM s) AS archive FROM s),
        o AS (SELECT *, CAST(sum(strlen(one)) OVER (PARTITION BY archive ORDER BY record_id) AS BIGINT) - strlen(one) AS "offset" FROM p)
        SELECT archive, "offset", record_id, CASE fate WHEN 5 THEN 'changed' ELSE 'missing' END AS damage,
               sha256(one) AS digest_1, CASE fate WHEN 5 THEN sha256(two) END AS digest_2
        FROM o WHERE fate IN (5, 6)""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
