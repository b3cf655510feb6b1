"""The queries of the subpackage: each applies one operator to its whole table; SQL twins where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import (
    collocations, cross_polytope, decontam, fim, host_rules, licenses, lm, packing, pii, quality, simhash, token_files, url_filter,
)
from hearthline.llm.common import table, tokenizer_path, whole_uri
from hearthline.session import shared_dir


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), out="x").drop("text")
    base = F.filter("x.detections", lambda d: d["base"])
    shown = F.filter("x.detections", lambda d: d["base"] | ~d["suppressed"])
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["first_word"])
    return docs.select(
        "doc_id", F.col("x.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"),
        names(shown).alias("labels"), F.coalesce(F.array_max(F.transform(shown, lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.train(docs), out="x").select("doc_id", "x.*")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = whole_uri(spark, f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")
    manifest = token_files.write_token_files(docs, folder, tokenizer_path())
    return token_files.read_token_files(manifest, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.add_score(docs, model)
    return scored.select(
        "doc_id", (~quality.learnable(F.col("doc_id"))).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_benchmark(docs, table(spark, sf_dir, "benchmark"), out="x").drop("text")
    hit = F.aggregate("x.spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    items = F.array_join(F.array_sort(F.transform("x.items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("x.n_words").alias("n_words"), hit.alias("n_hit"), F.size("x.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"), out="x")
    place = lambda s, kind: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("x.entities", lambda s: place(s, s["kind"]))
    terms = F.transform("x.terms", lambda s: place(s, F.lit("term")))
    count = lambda kind: F.size(F.filter("x.entities", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), out="x")
    return made.select(
        "doc_id", F.col("x.n").alias("n"), F.col("x.form").alias("form"), F.col("x.prefix_chars").alias("prefix_chars"),
        F.col("x.middle_chars").alias("middle_chars"), F.sha2("x.output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("x.output"), F.col("x.form")), 256).alias("restored_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_lm_score, op3_token_files, op4_quality, op5_host_rules, op6_packing, op7_decontamination, op8_pii,
    op9_simhash, op10_url_filter, op11_collocations, op12_neighbours, op13_fill_in_middle, pipeline,
)}

def _url_sql(depth: int = 4) -> str:
    """The URL filter in SQL: one common table expression per level of the template tree."""
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(v, h, p)}'" for v, h, p in rules) + " END"
    steps = [f"""
      parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   '{url_filter.UPPER}', '{url_filter.LOWERED}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
      ruled AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS base,
                  regexp_replace(path, '[0-9]+', '*', 'g') AS shape FROM parsed),
      shapes AS (SELECT host, shape, count(*) AS n, count(*) FILTER (WHERE base = 'block') AS bad,
                   count(*) FILTER (WHERE base = 'allow') AS good FROM ruled GROUP BY 1, 2),
      prior AS (SELECT (coalesce(sum(bad), 0) + 1)::DOUBLE / (coalesce(sum(bad), 0) + coalesce(sum(good), 0) + 2) AS p FROM shapes),
      hosts AS (SELECT host, (sum(bad) + 4::DOUBLE * p) / (sum(bad) + sum(good) + 4::DOUBLE) AS bad_share
                FROM shapes, prior GROUP BY host, p),
      tree0 AS (SELECT *, string_split(regexp_replace(shape, '^/', ''), '/') AS whole,
                  CASE WHEN len(whole) <= {depth} THEN whole ELSE
                    list_append(whole[1:{depth - 1}], array_to_string(whole[{depth}:], '/')) END AS parts, '' AS node FROM shapes JOIN hosts USING (host))"""]
    for k in range(depth):
        similar = """CASE WHEN bad + good = 0 AND bad0 + good0 = 0 THEN true WHEN bad + good = 0 OR bad0 + good0 = 0 THEN false
          ELSE (bad::DOUBLE / (bad + good) - bad0::DOUBLE / (bad0 + good0)) * (bad::DOUBLE / (bad + good) - bad0::DOUBLE / (bad0 + good0))
            <= 3.84::DOUBLE * ((bad + bad0)::DOUBLE / (bad + good + bad0 + good0))
               * (1 - (bad + bad0)::DOUBLE / (bad + good + bad0 + good0)) * (1::DOUBLE / (bad + good) + 1::DOUBLE / (bad0 + good0)) END"""
        steps.append(f"""
      child{k} AS (SELECT host, node, parts[{k + 1}] AS part, sum(n) AS n, sum(bad) AS bad, sum(good) AS good
                   FROM tree{k} WHERE len(parts) > {k} GROUP BY 1, 2, 3),
      wide{k} AS (SELECT host, node FROM child{k} GROUP BY 1, 2 HAVING count(*) >= 20 AND sum(n) < 3 * count(*)),
      given{k} AS (SELECT c.*, CASE WHEN w.host IS NOT NULL THEN '*' ELSE part END AS name
                   FROM child{k} c LEFT JOIN wide{k} w USING (host, node)),
      named{k} AS (SELECT host, node, name, sum(bad) AS bad, sum(good) AS good,
                     CASE WHEN sum(bad) + sum(good) > 0 THEN sum(bad)::DOUBLE / (sum(bad) + sum(good)) ELSE -1 END AS share
                   FROM given{k} GROUP BY 1, 2, 3),
      lagged{k} AS (SELECT *, lag(bad) OVER w AS bad0, lag(good) OVER w AS good0 FROM named{k}
                    WINDOW w AS (PARTITION BY host, node ORDER BY share, name)),
      branch{k} AS (SELECT *, sum(CASE WHEN bad0 IS NOT NULL AND {similar} THEN 0 ELSE 1 END)
                      OVER (PARTITION BY host, node ORDER BY share, name ROWS UNBOUNDED PRECEDING) AS branch FROM lagged{k}),
      label{k} AS (SELECT host, node, branch, min(name) || CASE WHEN count(*) > 1 THEN '+' || (count(*) - 1) ELSE '' END AS label,
                     sum(bad) AS b_bad, sum(good) AS b_good
                   FROM branch{k} GROUP BY 1, 2, 3),
      tree{k + 1} AS (SELECT t.* EXCLUDE (node, bad_share), CASE WHEN len(parts) > {k} THEN t.node || '/' || l.label ELSE t.node END AS node,
                        CASE WHEN len(parts) > {k} THEN (b_bad + 4::DOUBLE * bad_share) / (b_bad + b_good + 4::DOUBLE)
                          ELSE bad_share END AS bad_share
                      FROM tree{k} t LEFT JOIN given{k} g ON g.host = t.host AND g.node = t.node AND g.part = t.parts[{k + 1}]
                      LEFT JOIN branch{k} b ON b.host = g.host AND b.node = g.node AND b.name = g.name
                      LEFT JOIN label{k} l ON l.host = b.host AND l.node = b.node AND l.branch = b.branch)""")
    return "WITH " + ",".join(steps) + f""",
      judged AS (SELECT host, shape, CASE WHEN bad_share >= 0.8::DOUBLE THEN 'block' ELSE 'allow' END AS verdict FROM tree{depth})
    SELECT page_id, host, path, rule, coalesce(base, j.verdict) AS verdict FROM ruled JOIN judged j USING (host, shape)"""


UPPER, LOWER = url_filter.UPPER, url_filter.LOWERED
HOST_RULES_SQL = r"""
    WITH cut AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
        row_number() OVER () AS r FROM documents),
      win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS v FROM
        (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM cut)),
      again AS (SELECT r, i FROM win JOIN (SELECT r, v FROM win GROUP BY 1, 2 HAVING count(*) > 1) USING (r, v)),
      rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM again) GROUP BY 1),
      m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        len(l) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM cut LEFT JOIN rep USING (r)),
      f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines
          OR word_chars < 2 * n_words OR word_chars > 14 * n_words AS failed FROM m),
      h AS (SELECT source, count(*) AS n, count_if(failed) AS k FROM f GROUP BY 1),
      s AS (SELECT least(greatest(avg(k / n), 1e-3), 1 - 1e-3) AS mean, coalesce(var_samp(k / n), 0) AS var, avg(1 / n) AS noise FROM h),
      p AS (SELECT mean, CASE WHEN var - mean * (1 - mean) * noise <= 0 THEN 1000
        ELSE least(greatest(mean * (1 - mean) / (var - mean * (1 - mean) * noise) - 1, 2), 1000) END AS weight FROM s),
      v AS (SELECT source, (k + mean * weight) / (n + weight) >= 0.5 AS rejected FROM h, p)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT rejected AS kept
    FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
      b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
      bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS v FROM
        (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
      sizes AS (SELECT DISTINCT k FROM bw),
      dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS v FROM
        (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
      hit AS (SELECT r, k, i, item_id FROM dw JOIN bw USING (k, v)),
      n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
      items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM
        (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN n USING (r) LEFT JOIN items USING (r)"""

COLLOCATIONS_SQL = rf"""
    WITH piece AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
      total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY 1),
      gram AS (SELECT lang, w[i:i + k - 1] AS words FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece), range(1, 6) t(k)
        WHERE i + k - 1 <= len(w)),
      f AS (SELECT lang, words, count(*) AS f FROM gram GROUP BY 1, 2 HAVING count(*) >= 100),
      cut AS (SELECT c.lang, c.words, k, c.f AS a, l.f AS l, r.f AS r, n,
          ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, len(words))) AS k FROM f WHERE len(words) > 1) c
        JOIN f l ON l.lang = c.lang AND l.words = c.words[1:k] JOIN f r ON r.lang = c.lang AND r.words = c.words[k + 1:]
        JOIN total ON total.lang = c.lang),
      low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
      inner_ AS (SELECT lang, words[i:j] AS words, max(f) AS longer FROM
        (SELECT *, unnest(range(i + 1, len(words) + 1)) AS j FROM (SELECT *, unnest(range(1, len(words))) AS i FROM f WHERE len(words) > 2))
        WHERE j - i + 1 < len(words) GROUP BY 1, 2),
      kept AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM low LEFT JOIN inner_ USING (lang, words)
        WHERE longer IS NULL OR 100 * longer < 100 * a)
    SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
    WHERE rank <= 2000"""

FILL_SQL = r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS key,
        regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
      h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || key[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || key[9:16])::BIGINT % (len(u) + 1) AS b,
        CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR ('0x' || key[17:24])::BIGINT % 100 >= 100
          THEN 'plain' WHEN ('0x' || key[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM t),
      p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
        array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM h)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM p"""

#: The others have no twin: trained models, XXH64, a tokenizer, hundreds of regular expressions, corpus disclosure or an
#: approximate search.
ORACLES: dict[str, str] = {
    "op5_host_rules": HOST_RULES_SQL, "op7_decontamination": DECONTAMINATION_SQL, "op10_url_filter": _url_sql(),
    "op11_collocations": COLLOCATIONS_SQL, "op13_fill_in_middle": FILL_SQL,
}
