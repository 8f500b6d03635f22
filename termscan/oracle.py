"""The named queries in DuckDB SQL, over the whole tables and whole texts."""

from __future__ import annotations

from termscan import queries as q
from termscan.functions.patterns import escape
from termscan.operators import reports


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any_case(pattern: str) -> str:
    return _text("(?i)" + pattern)


DOCUMENTS = f"SELECT {q.DOCUMENT_PATH} AS path, octet_length(encode(text))::BIGINT AS length, text FROM documents"
EDITION = f"SELECT path, regexp_replace(text, {_text(q.EDITION_CUT)}, '', 'g') AS text FROM ({DOCUMENTS})"
PAGES = "SELECT url AS path, octet_length(encode(html))::BIGINT AS length, html AS text FROM pages"
TURNS = f"SELECT {q.TURN_PATH} AS path, octet_length(encode(text))::BIGINT AS length, text FROM conversations"

EXT = r"lower(regexp_extract(path, '(\.[^./\\]+)$', 1))"
BASE_NAME = r"regexp_extract(path, '[^/\\]*$')"
THIRD_PART = "CASE WHEN len(string_split(path, '/')) >= 3 THEN string_split(path, '/')[3] ELSE string_split(path, '/')[-1] END"


def _below(root: str) -> str:
    stem = root.rstrip("/")
    size = len(stem)
    return (f"(lower(substr(path, 1, {size})) = lower({_text(stem)}) AND substr(path, {size + 1}, 1) = '/' "
            f"AND ltrim(substr(path, {size + 1}), '/') <> '')")


def _repo(roots) -> str:
    cases = "".join(f"WHEN {_below(r)} THEN string_split(ltrim(substr(path, {len(r.rstrip('/')) + 1}), '/'), '/')[1] " for r in roots)
    return f"CASE {cases} ELSE {THIRD_PART} END" if cases else THIRD_PART


def _first_root(roots) -> str:
    return "CASE " + " ".join(f"WHEN {_below(r)} THEN {_text(r)}" for r in roots) + " END"


def _hint(pattern: str) -> str:
    return f"regexp_matches(text, {_any_case(pattern)})"


def _bucket(spec) -> str:
    planned, code = _hint(spec.planned_hints_regex), _hint(spec.code_hints_regex)
    return (f"CASE WHEN {planned} AND {code} THEN 'Overlap' WHEN {planned} THEN 'Planned' "
            f"WHEN {code} THEN 'Code' ELSE 'Unknown' END")


def _terms(terms) -> str:
    rows = ", ".join(f"({i}, {_text(t)}, {_any_case(escape(t))})" for i, t in enumerate(terms))
    return (f"SELECT * FROM (VALUES {rows}) AS v(term_id, term, rx) WHERE trim(term) <> '' "
            "QUALIFY row_number() OVER (PARTITION BY lower(term) ORDER BY term_id) = 1")


def _matched(files: str, spec) -> str:
    return f"""
      SELECT path, text, term, {EXT} AS ext, {_repo(spec.include_paths)} AS repo, bucket,
             len(regexp_extract_all(text, rx))::INTEGER AS frequency,
             strpos(text, regexp_extract(text, rx))::INTEGER AS position
      FROM (SELECT *, {_bucket(spec)} AS bucket FROM ({files}) WHERE text <> '')
      CROSS JOIN ({_terms(spec.anchor_terms)}) WHERE regexp_matches(text, rx)"""


def _hits(files: str, spec) -> str:
    return f"""
      SELECT term, repo, path AS file, ext, bucket, frequency,
             trim(regexp_replace(substr(text, line_start, CASE WHEN span >= 0 THEN least(240, span) ELSE 240 END),
                                 '[\\s\\p{{Z}}]+', ' ', 'g')) AS context, path, position
      FROM (SELECT *, strpos(substr(text, position), chr(10)) AS ahead,
                   position - len(string_split(substr(text, 1, position - 1), chr(10))[-1]) AS line_start,
                   CASE WHEN ahead > 0 THEN position + ahead - 1 - line_start ELSE -1 END AS span
            FROM ({_matched(files, spec)}))"""


HIT_LIST = "term, repo, file, ext, bucket, frequency, context"
HITS = _hits(DOCUMENTS, q.SPEC)
EDITION_HITS = _hits(EDITION, q.EDITION_SPEC)


def _tiers(hits: str, crest: float = 0.9, slopes: float = 0.6) -> str:
    return f"""
      SELECT term, total, round_even(share, 3)::DOUBLE AS score,
             CASE WHEN share >= {crest} THEN 'Crest' WHEN share >= {slopes} THEN 'Slopes' ELSE 'Base' END AS tier
      FROM (SELECT *, total::DOUBLE / max(total) OVER () AS share
            FROM (SELECT min(term) AS term, sum(frequency)::BIGINT AS total FROM ({hits}) GROUP BY lower(term)))"""


def _counts(hits: str, column: str) -> str:
    return f"SELECT {column}, count(*) AS items FROM ({hits}) GROUP BY {column}"


def _top_repos(hits: str) -> str:
    return f"{_counts(hits, 'repo')} ORDER BY items DESC, repo LIMIT 10"


def _examples(hits: str) -> str:
    return (f"SELECT term, context AS example FROM ({hits}) "
            "QUALIFY row_number() OVER (PARTITION BY lower(term) ORDER BY frequency DESC, file) = 1")


def _fixed(rows) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({s}, {p}, {_text(line)})" for s, p, line in rows) + ") AS v(section, place, line)"


def _numbered(parts) -> str:
    union = " UNION ALL ".join(f"SELECT section, place, line FROM ({p})" for p in parts)
    return f"SELECT (row_number() OVER (ORDER BY section, place))::INTEGER AS line_no, line FROM ({union})"


def _place(order: str) -> str:
    return f"row_number() OVER (ORDER BY {order})"


def _word_map(hits: str) -> str:
    head = _fixed([(0, i, line) for i, line in enumerate(reports.WORD_MAP_HEAD)])
    body = f"""SELECT 1 AS section, {_place('total DESC, t.term')} AS place,
        concat('| ', t.term, ' | ', tier, ' | ', total, ' | ', replace(example, '|', '\\|'), ' |') AS line
        FROM ({_tiers(hits)}) t LEFT JOIN ({_examples(hits)}) e ON lower(t.term) = lower(e.term)"""
    return _numbered([head, body])


def _section_bodies(hits: str, fixed: bool = False) -> dict[str, str]:
    tiers = _tiers(hits)
    score = "CASE WHEN score = 1 THEN '1' WHEN score = 0 THEN '0' ELSE rtrim(printf('%.3f', score), '0') END"
    score = "printf('%.3f', score)" if fixed else score
    return {
        "bucket": f"SELECT bucket AS name, items AS value, concat('| ', bucket, ' | ', items, ' |') AS line FROM ({_counts(hits, 'bucket')})",
        "tier": f"SELECT tier AS name, count(*) AS value, concat('| ', tier, ' | ', count(*), ' |') AS line FROM ({tiers}) GROUP BY tier",
        "repo": f"SELECT repo AS name, items AS value, concat('| ', repo, ' | ', items, ' |') AS line FROM ({_top_repos(hits)})",
        "term": f"SELECT term AS name, total AS value, concat('| ', term, ' | ', tier, ' | ', total, ' | ', {score}, ' |') AS line FROM ({tiers}) ORDER BY total DESC, term LIMIT 15",
    }


def _summary(hits: str, fixed: bool = False) -> str:
    rows = [(0, i, line) for i, line in enumerate(reports.SUMMARY_TITLE)]
    parts = []
    for number, (name, body) in enumerate(_section_bodies(hits, fixed).items(), start=1):
        head = reports.SUMMARY_SECTIONS[name]
        rows += [(number, i - len(head), line) for i, line in enumerate(head)]
        rows += [(number, 1000000, "")] if number < 4 else []
        parts.append(f"SELECT {number} AS section, {_place('value DESC, name')} AS place, line FROM ({body})")
    return _numbered([_fixed(rows), *parts])


def _charts(hits: str) -> str:
    rows = [(0, i, line) for i, line in enumerate(reports.CHARTS_TITLE)]
    parts = []
    for number, (name, title) in enumerate(reports.CHART_TITLES.items(), start=1):
        head = ["```mermaid", "pie showData", "  title " + title]
        rows += [(number, i - 3, line) for i, line in enumerate(head)]
        rows += [(number, 1000000, "```")] + ([(number, 1000001, "")] if number < 2 else [])
        parts.append(f"""SELECT {number} AS section, {_place('value DESC, name')} AS place,
            concat('  "', name, '" : ', value) AS line FROM ({_section_bodies(hits)[name]})""")
    return _numbered([_fixed(rows), *parts])


def _files(condition: str) -> str:
    return f"SELECT path, length FROM ({DOCUMENTS}) WHERE {condition}"


# The ignore rules of the glob query, written out by hand in order.
RULE_PATTERNS = [
    ("^.*/bin/.*$", True), ("^.*/out_cli/[^/]*$", True), (r"^.*/[^/]*\.md$", False),
    ("^/corpus/src[^/]/en/[^/]*$", True), ("^/corpus/src4/.*$", False), (r"^/corpus/[^/]*\.txt$", True),
]


def _excluded() -> str:
    cases = " ".join(f"WHEN regexp_matches(path, {_any_case(rx)}) THEN {verdict}" for rx, verdict in reversed(RULE_PATTERNS))
    return f"(CASE {cases} ELSE false END)"


FILTERED = f"""SELECT * FROM ({DOCUMENTS}) WHERE length <= 2 * 1024 * 1024 AND NOT starts_with(path, '/corpus/src3/')
    AND lower({BASE_NAME}) NOT IN ('summary.md', 'wordmap_raw.csv', 'wordmap_table.md')
    AND {EXT} IN ('.md', '.txt', '.html')
    AND NOT (regexp_matches(path, '(?i)^.*/bin/.*$') AND NOT regexp_matches(path, '(?i)^.*/bin/[^/]*\\.md$'))
    AND NOT regexp_matches(path, {_any_case(q.FILTERED_SPEC.exclude_dir_regex)})
    AND NOT regexp_matches(path, {_any_case(q.FILTERED_SPEC.exclude_file_regex)})"""
FILTERED_HITS = _hits(FILTERED, q.FILTERED_SPEC)
PAGE_HITS = _hits(PAGES, q.PAGE_SPEC)
TURN_HITS = _hits(TURNS, q.TURN_SPEC)


def _rooted(pick: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT path, length, {i} AS root_id FROM ({DOCUMENTS}) WHERE {_below(r)}" for i, r in enumerate(q.ORDERED_ROOTS))
    return f"SELECT path, length, root_id::INTEGER AS root_id FROM ({rows}) {pick}"


LEFT_ROWS = f"SELECT {HIT_LIST} FROM ({HITS})"
RIGHT_ROWS = f"SELECT {HIT_LIST} FROM ({EDITION_HITS})"
DIFFERENCES = f"""
    SELECT side, count(*) AS copies, {HIT_LIST} FROM (
      SELECT 'left' AS side, * FROM (({LEFT_ROWS}) EXCEPT ALL ({RIGHT_ROWS}))
      UNION ALL SELECT 'right' AS side, * FROM (({RIGHT_ROWS}) EXCEPT ALL ({LEFT_ROWS})))
    GROUP BY ALL"""


def _column_differences() -> str:
    columns = ["repo", "ext", "bucket", "frequency", "context"]
    differs = ", ".join(f"(a.{c} IS DISTINCT FROM b.{c}) AS {c}_differs" for c in columns)
    return f"""
      SELECT coalesce(a.term, b.term) AS term, coalesce(a.file, b.file) AS file,
             CASE WHEN b.term IS NULL THEN 'left_only' WHEN a.term IS NULL THEN 'right_only' ELSE 'changed' END AS status,
             coalesce(a.frequency, 0)::BIGINT AS left_frequency, coalesce(b.frequency, 0)::BIGINT AS right_frequency, {differs}
      FROM ({LEFT_ROWS}) a FULL OUTER JOIN ({RIGHT_ROWS}) b ON a.term = b.term AND a.file = b.file
      WHERE a.term IS NULL OR b.term IS NULL OR {' OR '.join(f'(a.{c} IS DISTINCT FROM b.{c})' for c in columns)}"""


def _row_counts(left: str, right: str) -> str:
    return f"(SELECT count(*) FROM ({left})) AS left_rows, (SELECT count(*) FROM ({right})) AS right_rows"


PRUNED = f"""len(list_filter(generate_series(2, len(string_split(path, '/')) - 1),
    lambda i: regexp_matches(array_to_string(list_slice(string_split(path, '/'), 1, i), '/'), {_any_case(q.PRUNE_REGEX)}))) > 0"""

# The tree scan: what its filters leave, written out by hand.
TREE_FILES = """
    SELECT concat('/tree/source=', source, '/lang=', lang, '/doc_id=', doc_id) AS path, concat(text, chr(10)) AS text
    FROM documents WHERE source NOT IN ('src1', 'src13') AND lang <> 'de' AND NOT (source = 'src7' AND lang <> 'en')
      AND NOT (source = 'src5' AND lang = 'fr') AND doc_id % 10 <> 7"""
TREE_HITS = f"""SELECT * REPLACE ('.txt' AS ext,
        CASE WHEN starts_with(file, '/tree/source=src0/') THEN string_split(file, '/')[4] ELSE string_split(file, '/')[3] END AS repo)
    FROM ({_hits(TREE_FILES, q.TREE_SPEC)})"""
DIGEST = ("('0x' || substr(md5(concat_ws(chr(31), " + ", ".join(f"coalesce('=' || {c}, '-')" for c in HIT_LIST.split(", "))
          + ")), 1, 15))::BIGINT")
BACKSLASHED = f"""SELECT replace(CASE WHEN contains(path, '/en/') THEN regexp_replace(path, '^/corpus/[^/]+', '/corpus/ ') ELSE path END,
        '/', chr(92)) AS path FROM ({DOCUMENTS})"""

TREE_TOTALS = f"""
    SELECT term, concat('source=', source) AS repo, '.txt' AS ext, sum(len(regexp_extract_all(text, rx)))::BIGINT AS total
    FROM documents CROSS JOIN ({_terms(q.TERMS)}) WHERE regexp_matches(text, rx) GROUP BY term, source"""

ORACLE: dict[str, str] = {
    "term_tiers": _tiers(HITS),
    "doc_buckets": f"SELECT path, {_bucket(q.SPEC)} AS bucket FROM ({DOCUMENTS})",
    "doc_buckets_regex": f"SELECT path, {_bucket(q.FILTERED_SPEC)} AS bucket FROM ({DOCUMENTS})",
    "term_hits": LEFT_ROWS,
    "hit_context": f"SELECT path, term, position, context FROM ({HITS})",
    "ext_filter": _files(f"{EXT} IN ('.md', '.txt', '.py')"),
    "path_regex_exclude": _files(f"NOT regexp_matches(path, {_any_case(q.PATH_REGEX)})"),
    "file_regex_exclude": _files(f"NOT regexp_matches(path, {_any_case(q.FILE_REGEX)})"),
    "dir_exclude": _files(f"NOT ({PRUNED})"),
    "glob_exclude_last_match": _files(f"NOT {_excluded()}"),
    "glob_rule_table": f"""SELECT path, length FROM (SELECT doc_id, {q.DOCUMENT_PATH} AS path, octet_length(encode(text))::BIGINT AS length FROM documents)
        WHERE NOT CASE WHEN doc_id % 20 = 13 THEN false WHEN doc_id % 10 = 3 THEN true ELSE {_excluded()} END""",
    "size_filter": _files(f"length <= {q.SIZE_LIMIT}"),
    "own_output_exclude": _files("NOT starts_with(lower(path), '/corpus/src1/')"),
    "generated_exclude": _files(f"lower({BASE_NAME}) <> 'summary.md'"),
    "repo_attribution": f"""SELECT path, {_repo(['/corpus/'])} AS repo, {_repo(q.OTHER_ROOTS)} AS other_repo,
        {EXT} AS ext, {BASE_NAME} AS base_name FROM ({DOCUMENTS})""",
    "first_root_match": f"SELECT path, {_first_root(q.ORDERED_ROOTS)} AS root, {_repo(q.ORDERED_ROOTS)} AS repo FROM ({DOCUMENTS})",
    "first_root_table": f"""
        SELECT path, CASE WHEN own THEN first_id ELSE {2**40} END::BIGINT AS root_id,
               CASE WHEN own THEN concat('/CORPUS/', source, '/', lang, '/') ELSE '/corpus' END AS root,
               CASE WHEN own THEN string_split(path, '/')[5] ELSE source END AS repo
        FROM (SELECT source, lang, source NOT IN ('src7', 'src13') AS own, min(doc_id) OVER (PARTITION BY source, lang) AS first_id,
                     {q.DOCUMENT_PATH} AS path FROM documents)""",
    "bucket_distribution": _counts(HITS, "bucket"),
    "tier_distribution": f"SELECT tier, count(*) AS terms FROM ({_tiers(HITS)}) GROUP BY tier",
    "top_repos": _top_repos(HITS),
    "top_terms": f"{_tiers(HITS)} ORDER BY total DESC, term LIMIT 15",
    "largest_files": f"SELECT path, length FROM ({DOCUMENTS}) ORDER BY length DESC, path LIMIT 10",
    "scan_counts": f"""SELECT (SELECT count(*) FROM documents) AS files, count(*) AS hit_rows,
        count(DISTINCT file) AS files_with_hits FROM ({HITS})""",
    "top_example": _examples(HITS),
    "wordmap_lines": _word_map(HITS),
    "summary_lines": _summary(HITS),
    "pie_lines": _charts(HITS),
    "overlapping_roots_all": _rooted(""),
    "overlapping_roots_distinct": _rooted("QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY root_id, path) = 1"),
    "vocab_distinct": """
        SELECT item_id, place::INTEGER AS place, term FROM (
          SELECT item_id, unnest(range(len(words))) AS place, unnest(words) AS term
          FROM (SELECT item_id, string_split(text, ' ') AS words FROM benchmark))
        WHERE trim(term) <> '' QUALIFY row_number() OVER (PARTITION BY lower(term) ORDER BY item_id, place) = 1""",
    "large_vocabulary_tiers": _tiers(f"""
        SELECT term, ((length(low) - length(replace(low, lower(term), ''))) / length(term))::INTEGER AS frequency
        FROM (SELECT lower(text) AS low FROM documents) CROSS JOIN ({_terms(q.SYLLABLES)}) WHERE contains(low, lower(term))"""),
    "filtered_hits": f"SELECT {HIT_LIST} FROM ({FILTERED_HITS})",
    "filtered_tiers": _tiers(FILTERED_HITS, 0.66, 0.33),
    "page_hits": f"SELECT {HIT_LIST} FROM ({PAGE_HITS})",
    "page_tiers": _tiers(PAGE_HITS),
    "page_top_repos": _top_repos(PAGE_HITS),
    "conversation_hits": f"SELECT {HIT_LIST} FROM ({TURN_HITS})",
    "conversation_summary_lines": _summary(TURN_HITS),
    "diff_counts": f"SELECT {_row_counts(LEFT_ROWS, RIGHT_ROWS)}",
    "diff_equal": f"SELECT {_row_counts(LEFT_ROWS, RIGHT_ROWS)}, (SELECT count(*) = 0 FROM ({DIFFERENCES})) AS equal",
    "stored_diff_equal": f"SELECT {_row_counts(LEFT_ROWS, RIGHT_ROWS)}, (SELECT count(*) = 0 FROM ({DIFFERENCES})) AS equal",
    "same_equal": f"""SELECT {_row_counts(LEFT_ROWS, LEFT_ROWS)},
        (SELECT count(*) = 0 FROM (({LEFT_ROWS}) EXCEPT ALL (SELECT * FROM ({LEFT_ROWS}) ORDER BY file DESC))) AS equal""",
    "diff_hash": f"""SELECT count(*) AS row_count, coalesce(bit_xor(d), 0) AS hash_xor, coalesce(sum(d), 0)::DECIMAL(38, 0) AS hash_sum
        FROM (SELECT {DIGEST} AS d FROM ({LEFT_ROWS}))""",
    "diff_rows": DIFFERENCES,
    "digest_diff_rows": DIFFERENCES,
    "stored_diff_rows": DIFFERENCES,
    "diff_sample": f"{DIFFERENCES} ORDER BY {HIT_LIST}, side LIMIT 30",
    "diff_columns": _column_differences(),
    "digest_diff_columns": _column_differences(),
    "tree_repo_totals": TREE_TOTALS,
    "tree_piece_totals": TREE_TOTALS,
    "csv_reload": LEFT_ROWS,
    "csv_sorted_reload": LEFT_ROWS,
    "tree_largest_files": f"""
        SELECT concat('/tree/source=', source, '/lang=', lang, '/doc_id=', doc_id) AS path, octet_length(encode(text))::BIGINT + 1 AS length
        FROM documents ORDER BY length DESC, path LIMIT 10""",
    "tree_hits": f"SELECT {HIT_LIST} FROM ({TREE_HITS})",
    "tree_summary_lines": _summary(TREE_HITS),
    "tree_skipped": f"""SELECT '/tree/nowhere/' AS path, 'missing root' AS reason
        UNION ALL SELECT path, 'too long for one value' FROM ({TREE_FILES}) WHERE octet_length(encode(text)) > {q.SKIPPING_SPEC.longest_text_bytes}""",
    "decoded_texts": "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN concat(text, chr(65533)) ELSE text END AS text FROM documents",
    "duplicate_paths_tiers": _tiers(_hits(f"SELECT * FROM ({DOCUMENTS}) WHERE lower({BASE_NAME}) <> 'summary.md'", q.SPEC)),
    "unique_files": f"SELECT path, length FROM ({DOCUMENTS})",
    "mixed_spelling_tiers": f"""
        SELECT term, total, round_even(share, 3)::DOUBLE AS score,
               CASE WHEN share >= 0.9 THEN 'Crest' WHEN share >= 0.6 THEN 'Slopes' ELSE 'Base' END AS tier
        FROM (SELECT *, total::DOUBLE / max(total) OVER () AS share FROM (
          SELECT CASE WHEN bool_or(length(file) % 2 = 0) THEN upper(min(term)) ELSE min(term) END AS term,
                 sum(frequency)::BIGINT AS total FROM ({HITS}) GROUP BY lower(term)))""",
    "benchmark_vocabulary_tiers": """
        WITH v AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[ \\n.,]+')) AS term FROM benchmark),
        t AS (SELECT term, sum((length(low) - length(replace(low, term, ''))) // length(term))::BIGINT AS total
              FROM (SELECT lower(text) AS low FROM documents) CROSS JOIN v WHERE term <> '' AND contains(low, term) GROUP BY term)
        SELECT term, total, round_even(share, 3)::DOUBLE AS score,
               CASE WHEN share >= 0.9 THEN 'Crest' WHEN share >= 0.6 THEN 'Slopes' ELSE 'Base' END AS tier
        FROM (SELECT *, total::DOUBLE / max(total) OVER () AS share FROM t)""",
    "backslash_attribution": f"""
        SELECT path, replace(path, chr(92), '/') AS slashed,
               CASE WHEN trim(string_split(path, chr(92))[3]) = '' THEN '(root)' ELSE string_split(path, chr(92))[3] END AS repo,
               {EXT} AS ext, {BASE_NAME} AS base_name FROM ({BACKSLASHED})""",
    "emptied_texts": f"SELECT path, {_bucket(q.SPEC)} AS bucket FROM ({DOCUMENTS}) WHERE length % 3 <> 0",
    "invalid_hint_buckets": f"SELECT path, CASE WHEN {_hint(q.CODE)} THEN 'Code' ELSE 'Unknown' END AS bucket FROM ({DOCUMENTS})",
    "fixed_score_lines": _summary(HITS, fixed=True),
}
