"""Checks for identity scalars, history windows, blobs, churn, language and Q2 commit records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as idf
from ..functions.text import line_count, split_lines
from ..operators.blobs import blob_lookup, change_blob_pairs
from ..operators.churn import line_diff_counts, max_added_lines, ordered_line_diff_counts
from ..operators.classify import classify_changes, supported_files
from ..operators.history import (drop_deletions, first_n_changes, latest_file_version, newest_commits,
                                 restrict_to_repos, version_pairs)
from ..operators.stars import top_repos
from ..operators.windows import lag_over_group
from ..plans.commit_info import RECORD_SCHEMA, commit_records
from ..session import scratch_path
from ..sources.blobs import read_blob_files, write_blob_files
from ..sources.fixtures import FIXTURE_WALK_ORDER, blobs_view, changes_view, oracle_ctes
from ..sources.history import read_git_log, read_history_tables, write_git_log, write_history_tables
from ..sources.jsonl import read_record_lines, write_record_lines
from ..sources.tables import load_table
from . import register

CH = oracle_ctes("v_changes")
CHB = oracle_ctes("v_changes", "v_blobs")
WALK = "commit_time DESC, o DESC, n, p"
CHRON = "commit_time, o, n DESC, p DESC"
KEYS = ("repo_url", "commit_id", "file_path", "new_blob_id", "o", "n", "p")
KEYS_SQL = ", ".join(KEYS)
COMMIT_LIMIT = 301  # newest commits parsed: the reference's 300 plus its off-by-one
RECORD_LIMIT = 100
TOP_N = 150
MAX_ADDED = 100


def lines_sql(t: str) -> str:
    """DuckDB list of lines of ``t`` like str.splitlines (the fixture texts only use \\n)."""
    parts = f"string_split({t}, chr(10))"
    return (f"CASE WHEN {t} = '' THEN []::VARCHAR[] WHEN suffix({t}, chr(10)) "
            f"THEN list_slice({parts}, 1, len({parts}) - 1) ELSE {parts} END")


def lang_sql(path: str) -> str:
    return (f"CASE WHEN {path} LIKE '%.py' THEN 'python' WHEN {path} LIKE '%.java' THEN 'java' "
            f"WHEN {path} LIKE '%.js' THEN 'javascript' WHEN {path} LIKE '%.ipynb' THEN 'jupyter notebook' END")


AUTHOR_NAME_SQL = "trim(substr(author_raw, 1, instr(author_raw, '<') - 1))"
AUTHOR_EMAIL_SQL = "substr(author_raw, instr(author_raw, '<') + 1, length(author_raw) - instr(author_raw, '<') - 1)"


@register("author_identity", f"""{CH}
SELECT DISTINCT author_raw, {AUTHOR_NAME_SQL} AS author_name, {AUTHOR_EMAIL_SQL} AS author_email FROM v_changes""")
def author_identity(spark, sf_dir):
    c = changes_view(spark, sf_dir)
    return c.select("author_raw", idf.author_name("author_raw").alias("author_name"),
                    idf.author_email("author_raw").alias("author_email")).distinct()


@register("repo_identity", f"""{CH}
SELECT DISTINCT repo_url, regexp_extract(repo_url, '([^/]+/[^/]+)$', 1) AS repo_full_name,
  replace(regexp_extract(repo_url, '([^/]+/[^/]+)$', 1), '/', '_') AS repo_slug,
  'https://github.com/' || regexp_extract(repo_url, '([^/]+/[^/]+)$', 1) AS url_from_name,
  regexp_extract(repo_url, '([^/]*)$', 1) AS repo_name
FROM v_changes""")
def repo_identity(spark, sf_dir):
    c = changes_view(spark, sf_dir).select("repo_url").distinct()
    full = idf.repo_full_name("repo_url")
    return c.select("repo_url", full.alias("repo_full_name"), idf.repo_slug("repo_url").alias("repo_slug"),
                    idf.repo_url_from_name(full).alias("url_from_name"),
                    idf.repo_identity(F.lit(None).cast("string"), "repo_url").alias("repo_name"))


@register("path_parts", f"""{CH}
SELECT DISTINCT file_path, regexp_extract(file_path, '([^/]*)$', 1) AS base_name,
  regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^([^.]*)', 1) AS stem,
  regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '([^.]*)$', 1) AS suffix
FROM v_changes""")
def path_parts(spark, sf_dir):
    c = changes_view(spark, sf_dir).select("file_path").distinct()
    return c.select("file_path", idf.base_name("file_path").alias("base_name"), idf.stem("file_path").alias("stem"),
                    idf.suffix("file_path").alias("suffix"))


def _history_flat(spark, sf_dir):
    """Fixture changes as the generic history layout (walk_index = order rank inside the commit day)."""
    c = changes_view(spark, sf_dir)
    return c.select("repo_url", "commit_id", "author_raw", "commit_time",
                    (-F.col("o")).alias("walk_index"),
                    (F.col("n") * F.lit(1 << 32) + F.col("p")).alias("change_index"),
                    F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("string").alias("old_blob_id"),
                    F.col("file_path").alias("new_path"), "new_blob_id")


@register("history_scan", f"""{CH}
SELECT repo_url, commit_id, author_raw, file_path, new_blob_id FROM v_changes""")
def history_scan(spark, sf_dir):
    commits_path, changes_path = scratch_path(spark, "commits"), scratch_path(spark, "changes")
    write_history_tables(_history_flat(spark, sf_dir), commits_path, changes_path)
    h = read_history_tables(spark, commits_path, changes_path)
    return h.select("repo_url", "commit_id", "author_raw", "file_path", "new_blob_id")


@register("git_log_scan", f"""{CH},
vp AS (SELECT *, lag(new_blob_id) OVER (PARTITION BY repo_url, file_path ORDER BY {CHRON}) AS old_blob_id FROM v_changes)
SELECT repo_url, commit_id, author_raw, file_path, new_blob_id, old_blob_id,
  CASE WHEN old_blob_id IS NULL THEN 'A' WHEN new_blob_id IS NULL THEN 'D' ELSE 'M' END AS status
FROM vp WHERE NOT (old_blob_id IS NULL AND new_blob_id IS NULL)""")
def git_log_scan(spark, sf_dir):
    c = changes_view(spark, sf_dir).select(*KEYS, "author_raw", "commit_time")
    vp = version_pairs(c, FIXTURE_WALK_ORDER)
    vp = vp.where(F.col("old_blob_id").isNotNull() | F.col("new_blob_id").isNotNull())
    vp = vp.withColumn("change_index", F.col("n") * F.lit(1 << 32) + F.col("p"))
    path = scratch_path(spark, "gitlog")
    write_git_log(vp, path)
    g = read_git_log(spark, path)
    return g.select("repo_url", "commit_id", "author_raw", "file_path", "new_blob_id", "old_blob_id", "status")


@register("git_log_merges", f"""{CH}
SELECT repo_url, commit_id, author_raw, file_path, new_blob_id, CASE parent_index WHEN 0 THEN 'a' || o ELSE 'b' || n END AS old_blob_id, parent_index
FROM v_changes, (SELECT unnest([0, 1]) AS parent_index) AS m WHERE new_blob_id IS NOT NULL""")
def git_log_merges(spark, sf_dir):
    """Every commit a merge of two parents: a change has a row per parent, each with its own old side."""
    # dealt by repository before they are grouped: one shuffle, and one file a repository
    c = changes_view(spark, sf_dir).where("new_blob_id IS NOT NULL").select("repo_url", "commit_id", "author_raw", "commit_time", "o", "n", "new_blob_id", "file_path").repartition("repo_url")
    line = F.concat(F.lit("::100644 100644 100644 a"), "o", F.lit(" b"), "n", F.lit(" "), "new_blob_id", F.lit(" MM\t"), "file_path")
    commits = c.groupBy("repo_url", "commit_id", "author_raw", "commit_time").agg(F.collect_list(line).alias("lines"))
    record = F.concat(F.lit("\x1e"), "commit_id", F.lit("\x1fp q\x1f"), "author_raw", F.lit("\x1f"), F.unix_timestamp(F.col("commit_time").cast("timestamp")).cast("string"),
                      F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n"))
    path = scratch_path(spark, "gitlog_merges")
    commits.select("repo_url", record.alias("value")).write.partitionBy("repo_url").text(path, compression="gzip")
    return read_git_log(spark, path).select("repo_url", "commit_id", "author_raw", "file_path", "new_blob_id", "old_blob_id", "parent_index")


# text and bytes of a part by p_partkey % 4: the bytes of a file and the text they are read as
BLOB_FILES = (("hex(encode('line 1' || chr(10) || 'x = ' || p || chr(10)))", "'line 1' || chr(10) || 'x = ' || p || chr(10)"), ("'E96162' || hex(encode(p::VARCHAR))", "chr(65533) || 'ab' || p"),
              ("'610062'", "'a' || chr(0) || 'b'"), ("'0A'", "chr(10)"))


@register("blob_files", f"""SELECT 'b' || p_partkey AS blob_id, md5(text) AS text_md5, contains(text, chr(0)) AS has_nul, length(bytes)::BIGINT // 2 AS n_bytes
FROM (SELECT *, CASE p % 4 {" ".join(f"WHEN {i} THEN {t}" for i, (_, t) in enumerate(BLOB_FILES))} END AS text,
             CASE p % 4 {" ".join(f"WHEN {i} THEN {b}" for i, (b, _) in enumerate(BLOB_FILES))} END AS bytes FROM (SELECT p_partkey, p_partkey AS p FROM part) AS x) AS y""")
def blob_files(spark, sf_dir):
    """Files named by blob id: UTF-8, broken UTF-8, a NUL, a line break."""
    p = load_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("p"), "p_partkey")
    content = (F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("line 1\nx = "), "p", F.lit("\n")).cast("binary"))
               .when(F.col("p_partkey") % 4 == 1, F.concat(F.unhex(F.lit("E96162")), F.col("p").cast("binary")))
               .when(F.col("p_partkey") % 4 == 2, F.unhex(F.lit("610062"))).otherwise(F.unhex(F.lit("0A"))))
    path = scratch_path(spark, "blob_files")
    write_blob_files(p.select(F.concat(F.lit("b"), "p").alias("blob_id"), content.alias("content")), path)
    b = read_blob_files(spark, path)
    return b.select("blob_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.contains("text", F.lit("\u0000")).alias("has_nul"), F.octet_length("content").cast("long").alias("n_bytes"))


@register("drop_deletions", f"""{CH}
SELECT {KEYS_SQL} FROM v_changes WHERE new_blob_id IS NOT NULL""")
def drop_deletions_q(spark, sf_dir):
    return drop_deletions(changes_view(spark, sf_dir)).select(*KEYS)


@register("top_repo_changes", f"""{CH},
top AS (SELECT repo_url FROM v_changes GROUP BY repo_url ORDER BY count(*) DESC, repo_url LIMIT 10)
SELECT {KEYS_SQL} FROM v_changes WHERE repo_url IN (SELECT repo_url FROM top)""")
def top_repo_changes(spark, sf_dir):
    c = changes_view(spark, sf_dir)
    top = top_repos(c, 10, "repo_url")
    return restrict_to_repos(c, top, "repo_url").select(*KEYS)


@register("first_n_changes", f"""{CH}
SELECT {KEYS_SQL} FROM v_changes QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY {WALK}) <= {RECORD_LIMIT}""")
def first_n_changes_q(spark, sf_dir):
    return first_n_changes(changes_view(spark, sf_dir), RECORD_LIMIT, FIXTURE_WALK_ORDER).select(*KEYS)


@register("newest_commits", f"""{CH},
commits AS (SELECT DISTINCT repo_url, commit_id, commit_time, o FROM v_changes)
SELECT repo_url, commit_id, CAST(row_number() OVER (PARTITION BY repo_url ORDER BY commit_time DESC, o DESC) AS BIGINT) AS commit_rank
FROM commits QUALIFY commit_rank <= {COMMIT_LIMIT}""")
def newest_commits_q(spark, sf_dir):
    order = (("commit_time", False), ("o", False))
    nc = newest_commits(changes_view(spark, sf_dir), COMMIT_LIMIT, order, ("repo_url", "commit_id"))
    from pyspark.sql import Window
    from ..operators.windows import sort_exprs
    w = Window.partitionBy("repo_url").orderBy(*sort_exprs(order))
    return nc.select("repo_url", "commit_id", F.row_number().over(w).cast("bigint").alias("commit_rank"))


@register("latest_file_version", f"""{CH}
SELECT repo_url, file_path, commit_id, new_blob_id FROM v_changes WHERE new_blob_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY repo_url, file_path ORDER BY {WALK}) = 1""")
def latest_file_version_q(spark, sf_dir):
    lv = latest_file_version(changes_view(spark, sf_dir), FIXTURE_WALK_ORDER)
    return lv.select("repo_url", "file_path", "commit_id", "new_blob_id")


VP_SQL = f"SELECT *, lag(new_blob_id) OVER (PARTITION BY repo_url, file_path ORDER BY {CHRON}) AS old_blob_id FROM v_changes"


@register("version_pairs", f"""{CH}, vp AS ({VP_SQL})
SELECT {KEYS_SQL}, old_blob_id FROM vp""")
def version_pairs_q(spark, sf_dir):
    return version_pairs(changes_view(spark, sf_dir), FIXTURE_WALK_ORDER).select(*KEYS, "old_blob_id")


@register("blob_lookup", f"""{CHB}
SELECT {", ".join("c." + k for k in KEYS)}, CAST(length(b.text) AS BIGINT) AS text_length
FROM v_changes c JOIN v_blobs b ON c.new_blob_id = b.blob_id""")
def blob_lookup_q(spark, sf_dir):
    c = changes_view(spark, sf_dir)
    b = blobs_view(spark, sf_dir, c)
    return blob_lookup(c, b).select(*KEYS, F.length("text").cast("bigint").alias("text_length"))


@register("change_blob_pairs", f"""{CHB}, vp AS ({VP_SQL})
SELECT {", ".join("vp." + k for k in KEYS)}, vp.old_blob_id, CAST(length(nb.text) AS BIGINT) AS new_length,
  CAST(length(ob.text) AS BIGINT) AS old_length
FROM vp JOIN v_blobs nb ON vp.new_blob_id = nb.blob_id LEFT JOIN v_blobs ob ON vp.old_blob_id = ob.blob_id""")
def change_blob_pairs_q(spark, sf_dir):
    c = changes_view(spark, sf_dir)
    b = blobs_view(spark, sf_dir, c)
    vp = version_pairs(c, FIXTURE_WALK_ORDER)
    out = change_blob_pairs(vp, b)
    return out.select(*KEYS, "old_blob_id", F.length("new_text").cast("bigint").alias("new_length"),
                      F.length("old_text").cast("bigint").alias("old_length"))


@register("added_lines_new_file", f"""
SELECT doc_id, CAST(len({lines_sql('text')}) AS INTEGER) AS added_lines_num, 0 AS deleted_lines_num FROM documents""")
def added_lines_new_file(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    return d.select("doc_id", line_count("text").alias("added_lines_num"), F.lit(0).alias("deleted_lines_num"))


@register("added_lines_new_blobs", f"""{CHB}, vp AS ({VP_SQL}),
nb AS (SELECT DISTINCT new_blob_id FROM vp WHERE old_blob_id IS NULL AND new_blob_id IS NOT NULL)
SELECT nb.new_blob_id AS blob_id, CAST(len({lines_sql('b.text')}) AS INTEGER) AS added_lines_num,
  0 AS deleted_lines_num
FROM nb JOIN v_blobs b ON b.blob_id = nb.new_blob_id""")
def added_lines_new_blobs(spark, sf_dir):
    """F8 on code: every change without an old version adds all of its lines."""
    c = changes_view(spark, sf_dir)
    b = blobs_view(spark, sf_dir, c)
    new_files = version_pairs(c, FIXTURE_WALK_ORDER).where(F.col("old_blob_id").isNull() & F.col("new_blob_id").isNotNull())
    d = line_diff_counts(new_files.select("new_blob_id", "old_blob_id"), b)
    return d.select(F.col("new_blob_id").alias("blob_id"), "added_lines_num", "deleted_lines_num")


def _document_pairs(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "source")
    pairs = lag_over_group(d, ["source"], [("doc_id", True)], ["doc_id"], ["prev_doc_id"])
    return pairs.select("source", F.col("doc_id").alias("new_blob_id"), F.col("prev_doc_id").alias("old_blob_id"))


DOC_DIFF_SQL = f"""
pairs AS (SELECT source, doc_id AS new_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS old_id FROM documents),
lines AS (SELECT doc_id, unnest({lines_sql('text')}) AS line FROM documents),
sides AS (SELECT p.new_id, p.old_id, l.line, 1 AS s FROM pairs p JOIN lines l ON l.doc_id = p.new_id WHERE p.old_id IS NOT NULL
          UNION ALL
          SELECT p.new_id, p.old_id, l.line, -1 AS s FROM pairs p JOIN lines l ON l.doc_id = p.old_id),
per_line AS (SELECT new_id, old_id, line, sum(s) AS d FROM sides GROUP BY new_id, old_id, line),
per_pair AS (SELECT new_id, old_id, sum(greatest(d, 0)) AS a, sum(greatest(-d, 0)) AS r FROM per_line GROUP BY new_id, old_id),
counts AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
diffs AS (
  SELECT p.source, p.new_id AS doc_id, p.old_id AS prev_doc_id,
    CAST(CASE WHEN p.old_id IS NULL THEN coalesce(c.n, 0) ELSE coalesce(pp.a, 0) END AS INTEGER) AS added_lines_num,
    CAST(CASE WHEN p.old_id IS NULL THEN 0 ELSE coalesce(pp.r, 0) END AS INTEGER) AS deleted_lines_num
  FROM pairs p LEFT JOIN per_pair pp ON pp.new_id = p.new_id AND pp.old_id = p.old_id
  LEFT JOIN counts c ON c.doc_id = p.new_id)"""


def _doc_diffs(spark, sf_dir, seq=False):
    pairs = _document_pairs(spark, sf_dir)
    texts = load_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), "text")
    fn = ordered_line_diff_counts if seq else line_diff_counts
    d = fn(pairs, texts).alias("d")
    p = pairs.alias("p")
    cond = (F.col("p.new_blob_id") == F.col("d.new_blob_id")) & F.col("p.old_blob_id").eqNullSafe(F.col("d.old_blob_id"))
    return p.join(d, cond).select("p.source", F.col("p.new_blob_id").alias("doc_id"),
                                  F.col("p.old_blob_id").alias("prev_doc_id"), "d.added_lines_num",
                                  "d.deleted_lines_num")


@register("line_diff_counts", f"""WITH {DOC_DIFF_SQL}
SELECT * FROM diffs""")
def line_diff_counts_q(spark, sf_dir):
    return _doc_diffs(spark, sf_dir)


def ordered_diff_sql(pairs: str, lines: str) -> str:
    """CTEs up to ``counted`` (new_id, old_id, added, deleted) in line order, over pairs(new_id, old_id) and
    lines(id, pos, line); the longest increasing run of anchors step by step in lists."""
    return f"""pairs AS ({pairs}),
lines AS ({lines}),
sides AS (SELECT p.new_id, p.old_id, 1 AS s, l.pos, l.line FROM pairs p JOIN lines l ON l.id = p.new_id WHERE p.old_id IS NOT NULL
          UNION ALL SELECT p.new_id, p.old_id, -1 AS s, l.pos, l.line FROM pairs p JOIN lines l ON l.id = p.old_id),
occ AS (SELECT *, count(*) FILTER (s = 1) OVER w AS nn, count(*) FILTER (s = -1) OVER w AS no, max(CASE WHEN s = -1 THEN pos END) OVER w AS po
        FROM sides WINDOW w AS (PARTITION BY new_id, old_id, line)),
seqs AS (SELECT new_id, old_id, list(pos ORDER BY pos) AS ns, list(po ORDER BY pos) AS os FROM occ WHERE s = 1 AND nn = 1 AND no = 1 GROUP BY ALL),
dp AS (SELECT new_id, old_id, ns, os, 1 AS i, [1::BIGINT] AS l, [0::BIGINT] AS p FROM seqs
       UNION ALL
       SELECT new_id, old_id, ns, os, i + 1, list_append(l, coalesce(b.l, 0) + 1), list_append(p, coalesce(b.j, 0)) FROM (
         SELECT *, list_max(list_transform(range(1, i + 1), lambda j: CASE WHEN os[j] < os[i + 1] THEN {{'l': l[j], 'j': j}} END)) AS b FROM dp WHERE i < len(os)) AS step),
run AS (SELECT new_id, old_id, ns, os, p, list_position(l, list_max(l))::BIGINT AS k FROM dp WHERE i = len(os)
        UNION ALL SELECT new_id, old_id, ns, os, p, p[k] FROM run WHERE p[k] > 0),
kept AS (SELECT new_id, old_id, 1 AS s, ns[k] AS pos FROM run UNION ALL SELECT new_id, old_id, -1, os[k] FROM run),
marked AS (SELECT o.*, k.pos IS NOT NULL AS anchor FROM occ o LEFT JOIN kept k ON k.new_id = o.new_id AND k.old_id = o.old_id AND k.s = o.s AND k.pos = o.pos),
placed AS (SELECT *, count(*) FILTER (anchor) OVER (PARTITION BY new_id, old_id, s ORDER BY pos) AS seg FROM marked),
per_line AS (SELECT new_id, old_id, seg, line, sum(s) AS d FROM placed WHERE NOT anchor GROUP BY ALL),
counted AS (SELECT new_id, old_id, sum(greatest(d, 0)) AS a, sum(greatest(-d, 0)) AS r FROM per_line GROUP BY ALL)"""


DOC_LINES_SQL = f"SELECT doc_id AS id, unnest({lines_sql('text')}) AS line, unnest(range(1, len({lines_sql('text')}) + 1)) AS pos FROM documents"


@register("line_diff_counts_seq", f"""WITH RECURSIVE {ordered_diff_sql(
    "SELECT doc_id AS new_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS old_id FROM documents", DOC_LINES_SQL)}
SELECT d.source, p.new_id AS doc_id, p.old_id AS prev_doc_id,
  CAST(CASE WHEN p.old_id IS NULL THEN (SELECT count(*) FROM lines l WHERE l.id = p.new_id) ELSE coalesce(c.a, 0) END AS INTEGER) AS added_lines_num,
  CAST(coalesce(c.r, 0) AS INTEGER) AS deleted_lines_num
FROM pairs p JOIN documents d ON d.doc_id = p.new_id LEFT JOIN counted c ON c.new_id = p.new_id""")
def line_diff_counts_seq_q(spark, sf_dir):
    """Order-aware counts of consecutive documents of a source."""
    return _doc_diffs(spark, sf_dir, seq=True)


# every document against itself with its last third of lines moved to the front and every seventh line said twice
MOVED_LINES_SQL = f"""
old_lines AS (SELECT doc_id, unnest({lines_sql('text')}) AS line, unnest(range(1, len({lines_sql('text')}) + 1)) AS pos, len({lines_sql('text')}) AS n FROM documents WHERE text IS NOT NULL),
new_lines AS (SELECT doc_id, line, ((pos - 1 + n // 3) % n) * 2 AS pos FROM old_lines UNION ALL
              SELECT doc_id, line, ((pos - 1 + n // 3) % n) * 2 + 1 FROM old_lines WHERE pos % 7 = 0)"""


@register("line_diff_counts_moved", f"""WITH RECURSIVE {MOVED_LINES_SQL},
{ordered_diff_sql("SELECT 'n' || doc_id AS new_id, 'o' || doc_id AS old_id FROM documents WHERE text IS NOT NULL",
                  "SELECT 'o' || doc_id AS id, line, pos FROM old_lines UNION ALL SELECT 'n' || doc_id, line, pos FROM new_lines")}
SELECT p.new_id, p.old_id, CAST(coalesce(c.a, 0) AS INTEGER) AS added_lines_num, CAST(coalesce(c.r, 0) AS INTEGER) AS deleted_lines_num
FROM pairs p LEFT JOIN counted c ON c.new_id = p.new_id""")
def line_diff_counts_moved(spark, sf_dir):
    """Versions in which lines move and repeat: a block that moves counts on both sides."""
    d = load_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", split_lines("text").alias("l"))
    n = F.size("l")
    twice = F.transform("l", lambda x, i: F.when((i + 1) % 7 == 0, F.array(x, x)).otherwise(F.array(x)))
    k = n - F.floor(n / 3).cast("int")
    moved = F.flatten(F.concat(F.slice(twice, k + 1, n - k), F.slice(twice, F.lit(1), k)))
    # a last line break for every line: a text of one empty line is not the empty text
    text = lambda lines: F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    new, old = F.concat(F.lit("n"), "doc_id"), F.concat(F.lit("o"), "doc_id")
    blobs = d.select(F.explode(F.array(F.struct(new.alias("blob_id"), text(moved).alias("text")), F.struct(old.alias("blob_id"), text(F.col("l")).alias("text")))).alias("b")).select("b.*")
    out = ordered_line_diff_counts(d.select(new.alias("new_id"), old.alias("old_id")), blobs, "new_id", "old_id")
    return out.select("new_id", "old_id", "added_lines_num", "deleted_lines_num")


@register("max_added_lines", f"""WITH {DOC_DIFF_SQL}
SELECT * FROM diffs WHERE added_lines_num <= {MAX_ADDED}""")
def max_added_lines_q(spark, sf_dir):
    return max_added_lines(_doc_diffs(spark, sf_dir), MAX_ADDED)


@register("classified_files", f"""{CH}
SELECT DISTINCT file_path, {lang_sql('file_path')} AS programming_language FROM v_changes
WHERE new_blob_id IS NOT NULL AND {lang_sql('file_path')} IS NOT NULL""")
def classified_files(spark, sf_dir):
    c = changes_view(spark, sf_dir)
    b = blobs_view(spark, sf_dir, c)
    return classify_changes(drop_deletions(c), b).select("file_path", "programming_language").distinct()


@register("supported_files", f"""{CH}
SELECT DISTINCT file_path, {lang_sql('file_path')} AS programming_language FROM v_changes
WHERE new_blob_id IS NOT NULL AND {lang_sql('file_path')} IN ('python', 'java', 'javascript')""")
def supported_files_q(spark, sf_dir):
    c = changes_view(spark, sf_dir)
    b = blobs_view(spark, sf_dir, c)
    cl = classify_changes(drop_deletions(c), b)
    return supported_files(cl, [" Python", "JAVA ", "javascript"]).select("file_path", "programming_language").distinct()


COMMIT_INFO_SQL = f"""{CHB},
top AS (SELECT regexp_extract(repo_url, '([^/]+/[^/]+)$', 1) AS repo_full_name FROM v_changes
        GROUP BY 1 ORDER BY count(*) DESC, repo_full_name LIMIT {TOP_N}),
ch AS (SELECT * FROM v_changes WHERE repo_url IN (SELECT 'https://github.com/' || repo_full_name FROM top)),
vp AS (SELECT *, lag(new_blob_id) OVER (PARTITION BY repo_url, file_path ORDER BY {CHRON}) AS old_blob_id FROM ch),
kept AS (SELECT *, {lang_sql('file_path')} AS programming_language FROM vp
         WHERE new_blob_id IS NOT NULL AND {lang_sql('file_path')} IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY {WALK}) <= {RECORD_LIMIT}),
lines AS (SELECT blob_id, unnest({lines_sql('text')}) AS line FROM v_blobs),
mods AS (SELECT DISTINCT new_blob_id, old_blob_id FROM kept WHERE old_blob_id IS NOT NULL),
sides AS (SELECT m.new_blob_id, m.old_blob_id, l.line, 1 AS s FROM mods m JOIN lines l ON l.blob_id = m.new_blob_id
          UNION ALL
          SELECT m.new_blob_id, m.old_blob_id, l.line, -1 AS s FROM mods m JOIN lines l ON l.blob_id = m.old_blob_id),
per_line AS (SELECT new_blob_id, old_blob_id, line, sum(s) AS d FROM sides GROUP BY ALL),
per_pair AS (SELECT new_blob_id, old_blob_id, sum(greatest(d, 0)) AS a, sum(greatest(-d, 0)) AS r FROM per_line GROUP BY ALL),
counts AS (SELECT blob_id, count(*) AS n FROM lines GROUP BY blob_id),
records AS (
  SELECT k.repo_url, {AUTHOR_NAME_SQL} AS author_name, {AUTHOR_EMAIL_SQL} AS author_email, k.commit_id,
    k.programming_language, k.file_path, k.new_blob_id AS blob_id,
    CAST(CASE WHEN k.old_blob_id IS NULL THEN coalesce(c.n, 0) ELSE coalesce(pp.a, 0) END AS INTEGER) AS added_lines_num,
    CAST(CASE WHEN k.old_blob_id IS NULL THEN 0 ELSE coalesce(pp.r, 0) END AS INTEGER) AS deleted_lines_num
  FROM kept k LEFT JOIN per_pair pp ON pp.new_blob_id = k.new_blob_id AND pp.old_blob_id = k.old_blob_id
  LEFT JOIN counts c ON c.blob_id = k.new_blob_id)"""


def commit_info_df(spark, sf_dir, classified=None):
    """Q2 on the fixture: each change is a star of its repository, top 150 by stars, 100 records each."""
    c = changes_view(spark, sf_dir)
    b = blobs_view(spark, sf_dir, c)
    star_list = c.select(idf.repo_full_name("repo_url").alias("repo_full_name"))
    top = top_repos(star_list, TOP_N).select(idf.repo_url_from_name("repo_full_name").alias("repo_url"))
    return commit_records(c, b, order=FIXTURE_WALK_ORDER, repos=top, limit=RECORD_LIMIT, classified=classified)


@register("commit_info", f"{COMMIT_INFO_SQL}\nSELECT * FROM records")
def commit_info(spark, sf_dir):
    return commit_info_df(spark, sf_dir)


@register("commit_info_scan", f"{COMMIT_INFO_SQL}\nSELECT * FROM records")
def commit_info_scan(spark, sf_dir):
    path = scratch_path(spark, "commit_info")
    write_record_lines(commit_info_df(spark, sf_dir), path)
    return read_record_lines(spark, path, RECORD_SCHEMA)


# ---- hot keys derived from the driver's tables: one repository, three paths ----------------------
HOT_WALK = FIXTURE_WALK_ORDER + (("s", True),)
HOT_CHRON = "commit_time, o, n DESC, p DESC, s DESC"
HOT_VIEW_SQL = ("SELECT 'https://github.com/org/monorepo' AS repo_url, commit_id, commit_time, "
                "concat('src/f', CAST(p % 3 AS STRING), '.py') AS file_path, new_blob_id, p, s, n, o FROM v_changes")
HOT_LIMIT = 5000  # above Spark's WindowGroupLimit threshold: exercises the sliced row number


def _hot_changes(spark, sf_dir):
    c = changes_view(spark, sf_dir)
    return c.select(F.lit("https://github.com/org/monorepo").alias("repo_url"), "commit_id", "commit_time",
                    F.concat(F.lit("src/f"), (F.col("p") % 3).cast("string"), F.lit(".py")).alias("file_path"),
                    "new_blob_id", "p", "s", "n", "o")


@register("hot_path_version_pairs", f"""{CH}, hot AS ({HOT_VIEW_SQL})
SELECT repo_url, commit_id, file_path, new_blob_id, o, n, p, s,
  lag(new_blob_id) OVER (PARTITION BY repo_url, file_path ORDER BY {HOT_CHRON}) AS old_blob_id FROM hot""")
def hot_path_version_pairs(spark, sf_dir):
    """Previous versions when each of three paths holds a third of all changes."""
    vp = version_pairs(_hot_changes(spark, sf_dir), HOT_WALK)
    return vp.select("repo_url", "commit_id", "file_path", "new_blob_id", "o", "n", "p", "s", "old_blob_id")


@register("hot_repo_first_changes", f"""{CH}, hot AS ({HOT_VIEW_SQL})
SELECT repo_url, commit_id, file_path, new_blob_id, o, n, p, s FROM hot
QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY commit_time DESC, o DESC, n, p, s) <= {HOT_LIMIT}""")
def hot_repo_first_changes(spark, sf_dir):
    """First records of a repository that holds every change, with a limit above the group-limit threshold."""
    out = first_n_changes(_hot_changes(spark, sf_dir), HOT_LIMIT, HOT_WALK)
    return out.select("repo_url", "commit_id", "file_path", "new_blob_id", "o", "n", "p", "s")
