"""Checks for inputs that the usual fixtures don't hold: names and contents that decide a language, deep nesting,
shared and missing blobs, merges, ties, lists longer than a bound, batches that are written again.

All rows come from ``lineitem`` / ``part``; expected names are stated by formula.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.language import programming_language
from ..operators.batching import repo_prefix_match, write_batches
from ..operators.blobs import missing_objects
from ..operators.churn import line_diff_counts, ordered_line_diff_counts
from ..operators.classify import Drops, classify_changes, supported_files
from ..operators.content_language import decide, learn
from ..operators.history import first_n_changes, restrict_to_repos, version_pairs
from ..operators.stars import co_starred_repos, star_counts, top_repos
from ..operators.symbols import extract_symbols, latest_symbols
from ..plans.commit_info import commit_records
from ..session import scratch_path
from ..sources.fixtures import FIXTURE_STAR_ORDER, FIXTURE_WALK_ORDER, blobs_view, changes_view, oracle_ctes, stars_view
from ..sources.jsonl import write_record_lines
from ..sources.tables import load_table
from . import ORACLES, register
from .history import CHB, CHRON, WALK, lang_sql, lines_sql

STARS = oracle_ctes("v_stars")
CH = oracle_ctes("v_changes")

# ---- language by name, extension, interpreter, content and place ---------------------------------
# path and text of a part by p_partkey % 10, in SQL that both engines read; the language it has
FILES = (
    ("concat('bin/tool', CAST(p AS STRING))", "concat('#!/usr/bin/env python3', chr(10), 'x = 1')", "'python'"),
    ("concat('d', CAST(p AS STRING), '/Makefile')", "'all:'", "'makefile'"),
    ("concat('src/a', CAST(p AS STRING), '.PY')", "'x'", "'python'"),
    ("concat('src/a', CAST(p AS STRING), '.py')", "concat(repeat('x', 9000), chr(10), 'tail', chr(0))", "NULL"),
    ("concat('vendor/lib', CAST(p AS STRING), '/a.js')", "'var a = 1;'", "NULL"),
    ("concat('img/a', CAST(p AS STRING), '.png')", "'x'", "NULL"),
    ("concat('bin/run', CAST(p AS STRING))", "concat('#!', repeat(' ', 300), '/usr/bin/python', chr(10))", "'python'"),
    ("concat('doc/README', CAST(p AS STRING))", "'hello'", "NULL"),
    ("concat('src/a', CAST(p AS STRING), '.java')", "''", "'java'"),
    ("concat('src/a', CAST(p AS STRING), '.js')", "concat('a', chr(0))", "NULL"),
)


def _case(column: int) -> str:
    return "CASE p % 10 " + " ".join(f"WHEN {i} THEN {f[column]}" for i, f in enumerate(FILES)) + " END"


FILES_SQL = f"SELECT p, {_case(0)} AS file_path, {_case(1)} AS text FROM (SELECT p_partkey AS p FROM {{part}}) AS x"


@register("language_rules", f"""SELECT file_path, {_case(2)} AS programming_language FROM ({FILES_SQL.format(part='part')}) AS f""")
def language_rules(spark, sf_dir):
    f = spark.sql(FILES_SQL, part=load_table(spark, sf_dir, "part"))
    return f.select("file_path", programming_language("file_path", "text").alias("programming_language"))


# ---- symbols: nesting of any depth, regex literals, anonymous classes, rare forms ----------------
N, C = "CAST(p AS STRING)", "chr(10)"
# a chain of names: 20,000 parts for some files, 20 for the rest
CHAIN = "repeat('.b', CASE WHEN p % 100 < 10 THEN 20000 ELSE 20 END)"
DEEP = 14


def _deep(opener: str, closer: str, inner: str) -> str:
    return f"concat('{opener * DEEP}', {inner}, '{closer * DEEP}')"


SNIPPETS = (
    ("python", f"concat('r', {N}, ' = call', {N}, '(', {_deep('[', ']', repr('kw=1'))}, ',', {C}, '  kw=', {_deep('(', ')', repr('z'))}, ')', {C}, "
               f"'def f', {N}, '(a, b=', {_deep('(', ')', repr('1, 2'))}, ', c=[1, (2, [3])]):', {C}, '    pass', {C})",
     f"['call' || {N}]", f"['r' || {N}, 'f' || {N}, 'a', 'b', 'c']"),
    ("javascript", f"concat('const re = /`/g;', {C}, 'var a', {N}, ' = 1;', {C}, 'let q = s.split(/', chr(39), '[/', chr(39), ']/);', {C}, 'let b', {N}, ' = x / y / z;', {C}, "
                   f"'const {{k = {{l: [m, {{n: [o]}}]}}}} = src', {N}, ';', {C})",
     "[]::VARCHAR[]", f"['re', 'a' || {N}, 'q', 'b' || {N}, 'src' || {N}]"),
    ("java", f"concat('import foo', {N}, ';', {C}, 'interface I', {N}, ' {{ int CONST = 1; }}', {C}, 'class K {{', {C}, "
             f"'  Map<String, List<Map<String, Set<Map<A, List<B>>>>>> m', {N}, ';', {C}, '  Object o = new R(g(1, h(2))) {{ int q', {N}, ' = 2; }};', {C}, "
             f"'  void run(int z) {{ ', {_deep('{ ', ' }', repr('int w = 1;'))}, ' }}', {C}, '}}', {C})",
     f"['foo' || {N}]", f"['I' || {N}, 'K', 'm' || {N}, 'o', 'q' || {N}, 'run', 'z']"),
    ("javascript", f"concat('o', {N}, {CHAIN}, ';', {C}, 'let v', {N}, ' = 1;', {C})", f"['o' || {N} || {CHAIN}]", f"['o' || {N} || {CHAIN}, 'v' || {N}]"),
    ("java", f"concat('package p', {N}, {CHAIN}, ';', {C}, 'import a', {N}, {CHAIN}, ';', {C}, 'import s', {N}, {CHAIN}, '.*;', {C}, 'class K {{', {C}, "
             f"'  private t', {CHAIN}, ' f', {N}, ' = new u', {CHAIN}, '(1);', {C}, '  r', {CHAIN}, ' run(q', {CHAIN}, ' z) {{ }}', {C}, '}}', {C})",
     f"['p' || {N} || {CHAIN}, 'a' || {N} || {CHAIN}, 's' || {N} || {CHAIN}]", f"['p' || {N} || {CHAIN}, 'K', 'f' || {N}, 'run', 'z']"),
)


def _pick(column: int) -> str:
    body = " ".join(f"WHEN {i} THEN {s[column]}" for i, s in enumerate(SNIPPETS))
    return f"CASE p % {len(SNIPPETS)} {body} END"


def _sorted_list(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), ',')"


LANGS = f"CASE p % {len(SNIPPETS)} " + " ".join(f"WHEN {i} THEN '{s[0]}'" for i, s in enumerate(SNIPPETS)) + " END"
SNIPPETS_SQL = f"SELECT {N} AS blob_id, {LANGS} AS programming_language, {_pick(1)} AS text FROM (SELECT p_partkey AS p FROM {{part}}) AS x"


@register("symbols_hard_cases", f"""SELECT {N} AS blob_id, {_sorted_list(_pick(2))} AS imports, {_sorted_list(_pick(3))} AS variables
FROM (SELECT p_partkey AS p FROM part) AS x""")
def symbols_hard_cases(spark, sf_dir):
    text = SNIPPETS_SQL.replace("{part}", "PARTS").replace("{", "{{").replace("}", "}}").replace("PARTS", "{part}")
    files = spark.sql(text, part=load_table(spark, sf_dir, "part"))
    out = extract_symbols(files)
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select("blob_id", joined("imports").alias("imports"), joined("variables").alias("variables"))


@register("symbols_shared_blob", """
SELECT 'r' || CAST(p_partkey % 5 AS VARCHAR) AS repo_url, 'a' || CAST(p_partkey AS VARCHAR) || e.ext AS file_path,
  CASE e.ext WHEN '.py' THEN 'v' || CAST(p_partkey AS VARCHAR) ELSE '' END AS variables_py,
  CASE e.ext WHEN '.py' THEN '' ELSE 'v' || CAST(p_partkey AS VARCHAR) END AS variables_js
FROM part, (SELECT unnest(['.py', '.js']) AS ext) AS e""")
def symbols_shared_blob(spark, sf_dir):
    """One blob is a Python and a JavaScript file: each path has the names of its own language."""
    p = load_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("p"), F.col("p_partkey"))
    blobs = p.select(F.col("p").alias("blob_id"), F.concat(F.lit("v"), "p", F.lit(" = 1\n")).alias("text"))
    c = p.select(F.concat(F.lit("r"), (F.col("p_partkey") % 5).cast("string")).alias("repo_url"), F.col("p").alias("commit_id"), F.col("p").alias("new_blob_id"),
                 F.explode(F.array(F.lit(".py"), F.lit(".js"))).alias("ext"), F.lit(1).alias("commit_time"))
    c = c.withColumn("file_path", F.concat(F.lit("a"), "commit_id", "ext"))
    order = (("commit_time", False), ("commit_id", True), ("file_path", True))
    out = latest_symbols(c, blobs, order=order, commit_order=(("commit_time", False), ("commit_id", True)), commit_limit=None)
    names = F.array_join("variables", ",")
    py = F.col("programming_language") == "python"
    return out.select("repo_url", "file_path", F.when(py, names).otherwise("").alias("variables_py"), F.when(py, "").otherwise(names).alias("variables_js"))


# ---- lists and keys longer than a bound ----------------------------------------------------------
@register("all_repo_changes", f"""{CH}
SELECT repo_url, count(*) AS n FROM v_changes GROUP BY repo_url""")
def all_repo_changes(spark, sf_dir):
    """A list that holds every repository restricts nothing."""
    c = changes_view(spark, sf_dir)
    return restrict_to_repos(c, c.select("repo_url").distinct()).groupBy("repo_url").agg(F.count(F.lit(1)).alias("n"))


LONG_SQL = "SELECT concat(repeat(concat('k', CAST(p_partkey AS STRING), '_'), 100), '.') AS key, p_partkey % 3 AS m FROM {part}"


@register("repo_prefix_match_long", f"""WITH k AS ({LONG_SQL.format(part='part')})
SELECT length(key)::BIGINT AS key_length, length(key || repeat('x', 100))::BIGINT AS entry_length, key FROM k WHERE m = 0""")
def repo_prefix_match_long(spark, sf_dir):
    """Keys and entries of hundreds of characters."""
    k = spark.sql(LONG_SQL, part=load_table(spark, sf_dir, "part"))
    entries = k.where("m = 0").select(F.concat("key", F.repeat(F.lit("x"), 100)).alias("entry"))
    out = repo_prefix_match(k.select("key"), entries)
    return out.select(F.length("key").cast("long").alias("key_length"), F.length("entry").cast("long").alias("entry_length"), "key")


@register("record_lines_equal", """SELECT count(*) AS n_records, 0::BIGINT AS n_too_long, true AS enough FROM lineitem""")
def record_lines_equal(spark, sf_dir):
    """Equal records of one repository: lines of at most 1,000 records that hold all of them."""
    path = scratch_path(spark, "equal_records")
    li = load_table(spark, sf_dir, "lineitem").select(F.lit("r").alias("repo_url"), F.lit("same").alias("x"))
    write_record_lines(li, path, max_records=1000)
    sizes = spark.read.text(path).select(F.regexp_count("value", F.lit("same")).alias("n"))
    return sizes.agg(F.sum("n").cast("long").alias("n_records"), F.count_if(F.col("n") > 1000).alias("n_too_long"),
                     (F.count(F.lit(1)) * 1000 >= F.sum("n")).alias("enough"))


# ---- missing objects, merges, ties, caps that cut, batches written again -------------------------
VP = f"SELECT *, lag(new_blob_id) OVER (PARTITION BY repo_url, file_path ORDER BY {CHRON}) AS old_blob_id FROM v_changes"
# blobs of every ninth part are lost
HELD_SQL = f"{CHB}, held AS (SELECT blob_id, text FROM v_blobs WHERE CAST(split_part(blob_id, '-', 2) AS BIGINT) % 9 <> 0), vp AS ({VP})"


def _held(spark, sf_dir):
    return blobs_view(spark, sf_dir).where((F.split_part("blob_id", F.lit("-"), F.lit(2)).cast("long") % 9) != 0).select("blob_id", "text")


@register("missing_objects", f"""{HELD_SQL}
SELECT repo_url, count(*) AS n_changes, count(*) FILTER ((new_blob_id IS NOT NULL AND new_blob_id NOT IN (SELECT blob_id FROM held))
  OR (old_blob_id IS NOT NULL AND old_blob_id NOT IN (SELECT blob_id FROM held))) AS n_dropped FROM vp GROUP BY repo_url""")
def missing_objects_q(spark, sf_dir):
    return missing_objects(version_pairs(changes_view(spark, sf_dir), FIXTURE_WALK_ORDER), _held(spark, sf_dir))


# counts of pairs (new_blob_id, old_blob_id) by multisets; in the fixture no line moves or repeats, so line order changes nothing
COUNTS_SQL = f"""
lines AS (SELECT blob_id, unnest({lines_sql('text')}) AS line FROM held),
sides AS (SELECT p.new_blob_id, p.old_blob_id, l.line, 1 AS s FROM pairs p JOIN lines l ON l.blob_id = p.new_blob_id
          UNION ALL SELECT p.new_blob_id, p.old_blob_id, l.line, -1 AS s FROM pairs p JOIN lines l ON l.blob_id = p.old_blob_id),
per_line AS (SELECT new_blob_id, old_blob_id, line, sum(s) AS d FROM sides GROUP BY ALL),
counted AS (SELECT new_blob_id, old_blob_id, CAST(sum(greatest(d, 0)) AS INTEGER) AS added_lines_num, CAST(sum(greatest(-d, 0)) AS INTEGER) AS deleted_lines_num FROM per_line GROUP BY ALL)"""


@register("diff_with_missing_objects", f"""{HELD_SQL},
pairs AS (SELECT DISTINCT new_blob_id, old_blob_id FROM vp WHERE new_blob_id IN (SELECT blob_id FROM held)
          AND (old_blob_id IS NULL OR old_blob_id IN (SELECT blob_id FROM held))),{COUNTS_SQL}
SELECT p.new_blob_id, p.old_blob_id, c.added_lines_num, c.deleted_lines_num FROM pairs p JOIN counted c ON c.new_blob_id = p.new_blob_id AND c.old_blob_id IS NOT DISTINCT FROM p.old_blob_id""")
def diff_with_missing_objects(spark, sf_dir):
    """Pairs that name a lost object have no counts."""
    vp = version_pairs(changes_view(spark, sf_dir), FIXTURE_WALK_ORDER)
    return line_diff_counts(vp, _held(spark, sf_dir))


@register("ordered_diff_with_missing_objects", ORACLES["diff_with_missing_objects"])
def ordered_diff_with_missing_objects(spark, sf_dir):
    vp = version_pairs(changes_view(spark, sf_dir), FIXTURE_WALK_ORDER)
    return ordered_line_diff_counts(vp, _held(spark, sf_dir))


OK_SQL = f"""{HELD_SQL},
top AS (SELECT repo_url FROM v_changes GROUP BY repo_url ORDER BY count(*) DESC, repo_url LIMIT 7),
ok AS (SELECT * FROM vp WHERE repo_url IN (SELECT repo_url FROM top) AND {lang_sql('file_path')} IS NOT NULL
       AND new_blob_id IN (SELECT blob_id FROM held) AND (old_blob_id IS NULL OR old_blob_id IN (SELECT blob_id FROM held))),
pairs AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY {WALK}) <= 20),{COUNTS_SQL}"""


@register("commit_info_missing_objects", f"""{OK_SQL}
SELECT DISTINCT p.repo_url, p.commit_id, p.file_path, p.new_blob_id AS blob_id, c.added_lines_num, c.deleted_lines_num
FROM pairs p JOIN counted c ON c.new_blob_id = p.new_blob_id AND c.old_blob_id IS NOT DISTINCT FROM p.old_blob_id""")
def commit_info_missing_objects(spark, sf_dir):
    """Seven repositories, 20 records each although some changes name lost objects."""
    c = changes_view(spark, sf_dir)
    top = top_repos(c, 7, "repo_url").select("repo_url")
    out = commit_records(c, _held(spark, sf_dir), order=FIXTURE_WALK_ORDER, repos=top, limit=20)
    return out.select("repo_url", "commit_id", "file_path", "blob_id", "added_lines_num", "deleted_lines_num").distinct()


@register("commit_info_drops", f"""{HELD_SQL}, marked AS (SELECT *, new_blob_id IN (SELECT blob_id FROM held) AS there,
  old_blob_id IS NULL OR old_blob_id IN (SELECT blob_id FROM held) AS old_there FROM vp)
SELECT unnest(['changes', 'deleted', 'vendored_or_image', 'missing_object', 'binary_or_unknown', 'missing_old_object']) AS reason,
  unnest([count(*), count(*) FILTER (new_blob_id IS NULL), 0, count(*) FILTER (new_blob_id IS NOT NULL AND NOT there),
          count(*) FILTER (there AND {lang_sql('file_path')} IS NULL), count(*) FILTER (there AND {lang_sql('file_path')} IS NOT NULL AND NOT old_there)]) AS n FROM marked""")
def commit_info_drops(spark, sf_dir):
    """What Q2 drops and why, counted by the jobs that compute its records."""
    drops = Drops()
    commit_records(changes_view(spark, sf_dir), _held(spark, sf_dir), order=FIXTURE_WALK_ORDER, limit=None, drops=drops).count()
    return spark.createDataFrame(list(drops.counts().items()), "reason string, n long")


# ---- content that decides what the name leaves open ------------------------------------------------
@register("ambiguous_languages", f"""{CHB}
SELECT b.blob_id, CASE c.p % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'javascript' END AS language
FROM v_blobs b JOIN (SELECT DISTINCT new_blob_id, p FROM v_changes) c ON c.new_blob_id = b.blob_id WHERE c.p % 5 IN (0, 1, 2) AND b.b % 2 = 0""")
def ambiguous_languages(spark, sf_dir):
    """Files whose extension is open between three languages, told apart by a model of the files whose name says it."""
    c = changes_view(spark, sf_dir)
    blobs = blobs_view(spark, sf_dir, c)
    files = supported_files(classify_changes(c, blobs)).select(F.col("new_blob_id").alias("blob_id"), "programming_language").distinct()
    even = blobs.where("b % 2 = 0").select("blob_id")
    open_ = files.join(even, "blob_id", "left_semi").select("blob_id", F.array(*[F.lit(x) for x in ("python", "java", "javascript")]).alias("candidates"))
    model = learn(files.join(even, "blob_id", "left_anti"), blobs)
    return decide(open_, blobs, model).select("blob_id", "language")


@register("first_changes_of_merges", f"""{CH}, m AS (SELECT repo_url, commit_id, file_path, commit_time, o, n, p, unnest([0, 1]) AS parent_index FROM v_changes)
SELECT repo_url, commit_id, file_path, parent_index FROM m
QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY {WALK}, parent_index) <= 31""")
def first_changes_of_merges(spark, sf_dir):
    """Merge changes have a row per parent: an odd limit cuts between two of them, always at the same place."""
    m = changes_view(spark, sf_dir).withColumn("parent_index", F.explode(F.array(F.lit(0), F.lit(1))))
    return first_n_changes(m, 31, FIXTURE_WALK_ORDER).select("repo_url", "commit_id", "file_path", "parent_index")


@register("top_repos_first_seen", f"""{STARS}
SELECT repo_full_name, count(*) AS stars FROM v_stars GROUP BY repo_full_name ORDER BY stars DESC, min(k1 * 10 + k2), repo_full_name LIMIT 150""")
def top_repos_first_seen(spark, sf_dir):
    """Ties go to the name that comes first in the list."""
    s = stars_view(spark, sf_dir).withColumn("seq", F.col("k1") * 10 + F.col("k2"))
    return top_repos(s, 150, seq_col="seq")


@register("co_starred_few_users", f"""{STARS},
seed AS (SELECT repo_full_name FROM v_stars GROUP BY repo_full_name ORDER BY count(*) DESC, repo_full_name LIMIT 1),
users AS (SELECT user_id FROM v_stars WHERE repo_full_name IN (SELECT repo_full_name FROM seed) GROUP BY user_id
  ORDER BY min(struct_pack(a := starred_at, b := k1, c := k2, d := k3, e := k4)), user_id LIMIT 5)
SELECT user_id, repo_full_name, k1, k2, k3, k4 FROM v_stars WHERE user_id IN (SELECT user_id FROM users)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY starred_at DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) <= 7""")
def co_starred_few_users(spark, sf_dir):
    """Caps that cut: five stargazers, seven stars each."""
    stars = stars_view(spark, sf_dir)
    seed = top_repos(stars, 1).select("repo_full_name")
    out = co_starred_repos(stars, seed, 5, 7, FIXTURE_STAR_ORDER)
    return out.select("user_id", "repo_full_name", "k1", "k2", "k3", "k4")


@register("batches_written_again", f"""{STARS}
SELECT repo_full_name, count(*) AS stars, CAST(length(repo_full_name) % 4 AS INTEGER) AS batch_id FROM v_stars GROUP BY repo_full_name""")
def batches_written_again(spark, sf_dir):
    """All batches, then one of them once more: the same rows."""
    path = scratch_path(spark, "batches")
    b = star_counts(stars_view(spark, sf_dir)).withColumn("batch_id", (F.length("repo_full_name") % 4).cast("int"))
    write_batches(b, path)
    write_batches(b.where("batch_id = 1"), path)
    return spark.read.schema("repo_full_name string, stars long, batch_id int").parquet(path)
