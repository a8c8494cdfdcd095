"""The answers of the queries in SQL over the given tables.

What operators find in rendered files is stated from the line items: each block
is one line item, so names, positions and contexts follow without reading text.
Other rules are restated.
"""

from __future__ import annotations

from codecorpus import derived
from codecorpus import fixed_values as fixed
from codecorpus.checks.queries import SCAN_BYTES, TARGET, TEXT_LINES

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    """A Python text as an SQL literal; line breaks are written out."""
    parts = value.replace("'", "''").split("\n")
    return "concat(" + ", chr(10), ".join(f"'{p}'" for p in parts) + ")"


def filled(template: str, **values: str) -> str:
    """A template with its ``{name}`` places taken by SQL expressions."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return "concat(" + ", ".join(values[p] if i % 2 else text(p) for i, p in enumerate(parts) if p) + ")"


def _block(suffix: str) -> str:
    values = {"p": "l_partkey", "s": "l_suppkey", "n": "l_linenumber", "m": "(l_partkey % 50)"}
    return filled(derived.BLOCKS[suffix], **values)


BLOCK = (
    "case o_orderkey % 8 "
    + " ".join(f"when {i} then {_block(s)}" for i, s in enumerate(derived.SUFFIXES))
    + " end"
)
SUFFIX = "case {key} % 8 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(derived.SUFFIXES)) + " end"

# --- tables the queries derive ----------------------------------------------

CTE: dict[str, str] = {}

# One row per line item: its block, and where the block begins in the file.
CTE["blocks"] = f"""
 select *, repo || '/' || folder || '/m' || o_orderkey || suffix as path,
        cast(coalesce(sum(length(block)) over before, 0) as integer) as pos,
        cast(coalesce(sum(length(block) - length(replace(block, chr(10), ''))) over before, 0) as integer) as line
 from (select o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey, {BLOCK} as block,
              {SUFFIX.format(key="o_orderkey")} as suffix, 'repo' || (o_custkey % 20) as repo,
              case o_orderkey % 13 when 0 then 'node_modules' when 1 then '.git'
                   else 'pkg' || (o_orderkey % 5) end as folder
       from orders join lineitem on o_orderkey = l_orderkey)
 window before as (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey
                   rows between unbounded preceding and 1 preceding)"""
CTE["files"] = """
 select repo, path, suffix, o_orderkey as file_id, cast(strlen(content) as bigint) as size, content
 from (select repo, path, suffix, o_orderkey,
              string_agg(block, '' order by l_linenumber, l_partkey, l_suppkey) as content
       from blocks group by repo, path, suffix, o_orderkey)"""
LANGUAGE = (
    "case suffix " + " ".join(f"when '{s}' then '{n}'" for s, n in fixed.LANGUAGE_BY_SUFFIX.items())
    + " else 'unknown' end"
)
CTE["classified"] = f"""
 select *, {LANGUAGE} as language,
        cast(length(content) - length(replace(content, chr(10), '')) as integer) as loc from files"""
CTE["docs"] = """
 select source as repo, source || '/doc_' || doc_id ||
        case doc_id % 4 when 0 then '.py' when 1 then '.js' when 2 then '.sql' else '.txt' end as path,
        cast(strlen(text) as bigint) as size, text as content from documents"""
CTE["doc_lines"] = """
 select *, case when content = '' then []
                when content like '%' || chr(10) then string_split(left(content, length(content) - 1), chr(10))
                else string_split(content, chr(10)) end as lines from docs"""
CTE["banded"] = """
 select repo, path, cast(len(lines) * 100 as integer) as loc,
        case when len(lines) * 100 > 800 then 'high' when len(lines) * 100 > 300 then 'medium' else 'low' end as difficulty,
        case when len(lines) * 100 > 800 then 1 when len(lines) * 100 > 300 then 2 else 3 end as priority
 from doc_lines"""

# Definitions inside a block: type, name, first character and line, and what follows the last one.
_DEFINITIONS = [
    (".py", "class_definition", "'C_' || l_partkey", "class ", 1, 1, 5),
    (".py", "function_definition", "'f_' || l_partkey || '_' || l_linenumber", "def ", 2, 1, 5),
    (".js", "function_declaration", "'f_' || l_partkey || '_' || l_linenumber", "function ", 1, 1, 6),
    (".java", "class_declaration", "'C_' || l_partkey", "public class", 1, 1, 5),
    (".java", "method_declaration", "'f_' || l_partkey || '_' || l_linenumber", "public int", 2, 3, 4),
    (".cpp", "function_definition", "'f_' || l_partkey || '_' || l_linenumber", "int f_", 1, 1, 3),
]
CTE["definitions"] = " union all ".join(
    f"""
 select repo, path, suffix, '{kind}' as node_type, {name} as name,
        substr(block, strpos(block, '{begin}'), length(block) - {rest} - strpos(block, '{begin}') + 1) as code,
        cast(pos + strpos(block, '{begin}') - 1 as integer) as start_char,
        cast(pos + length(block) - {rest} as integer) as end_char,
        cast(line + {first} as integer) as start_line, cast(line + {last} as integer) as end_line
 from blocks where suffix = '{suffix}'"""
    for suffix, kind, name, begin, first, rest, last in _DEFINITIONS
)
CTE["whole"] = """
 select repo, path, suffix, 'File' as node_type, 'm' || file_id || suffix as name, content as code,
        0 as start_char, cast(length(content) as integer) as end_char, 0 as start_line,
        cast(length(content) - length(replace(content, chr(10), '')) as integer) as end_line
 from files where suffix in ('.cs', '.sql', '.ts', '.rb')"""
CTE["segments"] = """
 select *, cast(row_number() over (partition by path order by start_char) - 1 as integer) as segment_no
 from (select * from definitions union all select * from whole)"""
_IMPORTS = [
    (".py", "import", "'import mod_' || m", "'mod_' || m", ""),
    (".js", "import", "'import { a } from \"mod_' || m || '\"'", "'mod_' || m", " || ';'"),
    (".java", "import", "'import com.mod_' || m || ';'", "'com.mod_' || m", ""),
    (".cpp", "include", "'#include <mod_' || m || '>'", "'mod_' || m", ""),
    (".cs", "using", "'using Mod_' || m || ';'", "'Mod_' || m", ""),
]
CTE["imports"] = " union all ".join(
    f"""
 select repo, path, suffix, '{kind}' as kind, {imported} as text, {module} as module, pos as start_char,
        {imported}{more} as statement
 from (select *, l_partkey % 50 as m from blocks) where suffix = '{suffix}'"""
    for suffix, kind, imported, module, more in _IMPORTS
)
# Where a piece of a block stands in the file: offset, and line counted from 1.
_SITE = """cast(pos + strpos(block, {piece}) - 1 as integer) as start_char,
 cast(line + 1 + len(string_split(left(block, strpos(block, {piece}) - 1), chr(10))) - 1 as integer) as line_no"""
CTE["calls"] = f"""
 select repo, path, 'g_' || l_suppkey as name, 'g_' || l_suppkey || '(' as text, {_SITE.format(piece="'g_' || l_suppkey")}
 from blocks where suffix in ('.py', '.js', '.java', '.cpp')"""
CTE["earlier"] = """
 select path, start_char, end_char, code as text from definitions
 union all
 select path, start_char, start_char + length(statement), statement from imports where suffix <> '.cs'"""
CTE["contexts"] = """
 select s.repo, s.path, s.segment_no,
        coalesce(string_agg(e.text, chr(10) order by e.start_char, e.end_char), '') as context_code
 from segments s left join earlier e on e.path = s.path and e.end_char < s.start_char
 group by s.repo, s.path, s.segment_no"""
CTE["responses"] = """
 select *, case when name like '%\\_3' escape '\\' then '' else '// converted ' || name end as response from segments"""
CTE["converted"] = f"""
 select repo, path as source_path, 'java/' || left(path, length(path) - length(suffix)) || '.java' as output_path,
        '{TARGET}' as target_language, 'java' as target_folder,
        {filled(fixed.CONVERTED_HEADER, source_language="language", target_language=f"'{TARGET}'")} || body as content
 from (select repo, path, string_agg(response, chr(10) || chr(10) order by segment_no) as body
       from responses where response <> '' group by repo, path)
      join (select path, suffix, language from classified) using (path)"""
CTE["pairs"] = f"""
 select o_orderkey as pair_id, 'm' || o_orderkey || {SUFFIX.format(key="o_orderkey")} as original_path, original_code,
        'm' || o_orderkey || case kind when 0 then '.java' when 1 then '.java' when 2 then '.js'
                             else {SUFFIX.format(key="o_orderkey")} end as converted_path,
        case kind when 0 then java when 1 then '// nothing' when 2 then js
             else case o_orderkey % 8 when 0 then '# note' else '// note' end || chr(10) || original_code
        end as converted_code,
        {SUFFIX.format(key="o_orderkey")} as suffix, kind
 from (select o_orderkey, cast(floor(o_orderkey / 8) as bigint) % 4 as kind,
              string_agg(block, '' order by l_linenumber, l_partkey, l_suppkey) as original_code,
              string_agg({_block(".java")}, '' order by l_linenumber, l_partkey, l_suppkey) as java,
              string_agg({_block(".js")}, '' order by l_linenumber, l_partkey, l_suppkey) as js
       from blocks group by o_orderkey)"""
CTE["languages"] = """
 select pair_id, ltrim(suffix, '.') as source_language,
        case kind when 0 then 'java' when 1 then 'java' when 2 then 'js' else ltrim(suffix, '.') end as target_language,
        source_language <> target_language as is_cross_language from pairs"""
CTE["attempts"] = """
 select user_id as request_id, cast(row_number() over (partition by user_id order by event_id) as integer) as attempt_no,
        event_type <> 'error' as ok, concat('```json', chr(10), props, chr(10), '```') as text, props from events"""
CTE["reviews"] = """
 select doc_id as pair_id, case when toxic = 1 then 'Overall: FAIL' when quality = 1 then 'Overall: PASS'
        when doc_id % 3 = 0 then 'PASS, though parts fail' when doc_id % 3 = 2 then 'unclear' end as text,
        case when doc_id % 17 = 0 then 'timeout' end as error from labels"""
CTE["pair_reviews"] = """
 select o_orderkey as pair_id, case o_orderpriority when '2-HIGH' then 'Overall: FAIL'
        when '3-MEDIUM' then 'FAIL: language-specific idioms are missing'
        when '4-NOT SPECIFIED' then 'Overall: PASS' when '5-LOW' then 'unclear' end as text,
        case when o_orderkey % 17 = 0 then 'timeout' end as error from orders"""
_TIMES = """l_quantity / 4 as original_s, l_quantity / 4 * (1 + 20 * l_discount) as converted_s,
        case when l_returnflag = 'R' then 1 else 0 end as original_rc,
        case when l_linestatus = 'F' and l_linenumber = 7 then 1 else 0 end as converted_rc"""
CTE["timings"] = f"select l_orderkey, l_partkey, l_suppkey, l_linenumber, {_TIMES} from lineitem"
CTE["pair_timings"] = """
 select l_orderkey as pair_id, max(original_s) as original_s, max(converted_s) as converted_s,
        max(original_rc) as original_rc, max(converted_rc) as converted_rc from timings group by l_orderkey"""


def _outcome(passed: str, details: str, source: str, columns: str) -> str:
    return f"select {columns}, {passed} as passed, {details} as details from {source}"


_SECONDS = {"converted": "printf('%.3f', converted_s)", "original": "printf('%.3f', original_s)"}
RUN_PASSED = """coalesce(original_s <= 10 and original_rc = 0 and converted_s <= 10 and converted_rc = 0
        and converted_s <= 2 * original_s, false)"""
RUN_DETAILS = f"""case when original_s is null or original_s > 10 then '{fixed.RUN_TIMED_OUT}'
        when original_rc <> 0 then {filled(fixed.RUN_ORIGINAL_FAILED, error="''")}
        when converted_s > 10 then '{fixed.RUN_TIMED_OUT}'
        when converted_rc <> 0 then {filled(fixed.RUN_CONVERTED_FAILED, error="''")}
        when converted_s <= 2 * original_s then {filled(fixed.RUN_ACCEPTABLE, **_SECONDS)}
        else {filled(fixed.RUN_REGRESSION, **_SECONDS)} end"""
REVIEW_PASSED = "case when error is not null then true when text is null then false else lower(text) not like '%fail%' end"
REVIEW_DETAILS = f"""case when error is not null then {filled(fixed.REVIEW_CALL_FAILED, error="error")}
        when text is null then '{fixed.REVIEW_NO_RESPONSE}' else text end"""


def _count(column: str, needle: str) -> str:
    return f"((length({column}) - length(replace({column}, {text(needle)}, ''))) // {len(needle)})"


def _counts(column: str, needles: list[str]) -> str:
    return "(" + " + ".join(_count(column, n) for n in needles) + ")"


def _metrics(column: str, language: str) -> str:
    functions = " ".join(f"when '{k}' then {_counts(column, v)}" for k, v in fixed.FUNCTION_MARKERS.items())
    return f"""struct_pack(
        total_lines := cast(len(string_split({column}, chr(10))) as integer),
        non_empty_lines := cast(len(list_filter(string_split({column}, chr(10)), lambda x: trim(x) <> '')) as integer),
        functions := cast(case {language} {functions} else 0 end as integer),
        classes := cast({_count(column, fixed.CLASS_MARKER)} as integer),
        control_structures := cast({_counts(column, fixed.CONTROL_MARKERS)} as integer))"""


def _score(metrics: str) -> str:
    return (
        f"(cast({metrics}.functions * 2 + {metrics}.classes * 3 + {metrics}.control_structures as double)"
        f" + {metrics}.non_empty_lines * cast(0.1 as double))"
    )


CTE["measured"] = f"""
 select pair_id, source_language as s, target_language as t, {_metrics("original_code", "s")} as o,
        {_metrics("converted_code", "t")} as c
 from pairs join languages using (pair_id)"""
CTE["complexity"] = f"""
 select pair_id, 'performance' as validator, rule = 6 as passed,
        case rule when 1 then {filled(fixed.COMPLEXITY_FUNCTIONS_MISSING, target="t")}
                  when 2 then {filled(fixed.COMPLEXITY_CLASSES_MISSING, target="t")}
                  when 3 then {filled(fixed.COMPLEXITY_CONTROL_MISSING, target="t")}
                  when 4 then {filled(fixed.COMPLEXITY_TOO_SIMPLE, target="t")}
                  when 5 then {filled(fixed.COMPLEXITY_TOO_COMPLEX, target="t")}
                  else {filled(fixed.COMPLEXITY_KEPT, source="s", target="t")} end as details
 from (select *, case when o.functions > 0 and c.functions / o.functions < 0.5 then 1
                      when o.classes > 0 and c.classes = 0 then 2
                      when s = t and o.control_structures > 0 and c.control_structures / o.control_structures < 0.3 then 3
                      when oscore > 0 and cscore / oscore < 0.3 then 4
                      when oscore > 0 and cscore / oscore > 3 then 5 else 6 end as rule
       from (select *, {_score("o")} as oscore, {_score("c")} as cscore from measured))"""


def _pattern_list(column: str, pattern: str) -> str:
    groups = pattern.count("(") - pattern.count("(?") - pattern.count(r"\(")
    literal = pattern.replace("'", "''")
    found = [f"regexp_extract_all({column}, '{literal}', {i})" for i in range(1, groups + 1)]
    if groups == 1:
        return found[0]
    both = " || ".join(f"coalesce(x[{i}], '')" for i in range(1, groups + 1))
    return f"list_transform(list_zip({', '.join(found)}), lambda x: {both})"


def _elements(column: str, language: str, field: str) -> str:
    cases = " ".join(
        f"when '{k}' then list_concat({', '.join(_pattern_list(column, p) for p in v[field])}, [])"
        for k, v in fixed.STRUCTURE_PATTERNS.items()
    )
    return f"array_to_string(case {language} {cases} else [] end, ',')"


FIELDS = ("functions", "classes", "imports", "variables", "control_structures")
CTE["elements"] = "select pair_id, source_language as s, target_language as t, " + ", ".join(
    f"{_elements(side + '_code', lang, f)} as {side}_{f}"
    for side, lang in (("original", "s"), ("converted", "t"))
    for f in FIELDS
) + " from pairs join languages using (pair_id)"
CTE["structure"] = f"""
 select pair_id, 'semantic' as validator, rule = 4 as passed,
        case rule when 1 then {filled(fixed.STRUCTURE_FUNCTIONS_MISSING, target="t")}
                  when 2 then {filled(fixed.STRUCTURE_CLASSES_MISSING, target="t")}
                  when 3 then {filled(fixed.STRUCTURE_CONTROL_MISSING, target="t")}
                  else {filled(fixed.STRUCTURE_KEPT, source="s", target="t")} end as details
 from (select *, case when original_functions <> '' and converted_functions = '' then 1
                      when original_classes <> '' and converted_classes = '' then 2
                      when s = t and original_control_structures <> '' and converted_control_structures = '' then 3
                      else 4 end as rule from elements)"""
CTE["verdicts"] = f"""
 select *, case when is_cross_language and not passed
                     and regexp_matches(lower(details), 'only supports python|cross-language|language-specific|defaulting to pass')
                then true else passed end as lenient_passed,
        case when lenient_passed and not passed then 'Cross-language conversion: ' || details else details end
        as lenient_details
 from (select pair_id, 'review' as validator, {REVIEW_PASSED} as passed, {REVIEW_DETAILS} as details
       from pairs left join pair_reviews using (pair_id)
       union all
       select pair_id, 'semantic', passed, details from structure
       join languages using (pair_id) where not (source_language = 'py' and target_language = 'py')
       union all
       select pair_id, 'semantic', true, '{fixed.SOURCES_MATCH}' from languages
       where source_language = 'py' and target_language = 'py'
       union all
       select pair_id, 'performance', passed, details from complexity
       join languages using (pair_id) where not (source_language = 'py' and target_language = 'py')
       union all
       select pair_id, 'performance', {RUN_PASSED}, {RUN_DETAILS} from languages left join pair_timings using (pair_id)
       where source_language = 'py' and target_language = 'py')
      join languages using (pair_id)"""
CTE["reports"] = """
 select pair_id, is_cross_language, case when is_cross_language then count_if(lenient_passed) >= 2
        else bool_and(lenient_passed) end as overall_passed, cast(count(*) as integer) as validators
 from verdicts group by pair_id, is_cross_language"""
CTE["requested"] = f"""
 select repo, path, segment_no, {filled(
    fixed.CONVERSION_REQUEST,
    source_language="language",
    target_language=f"'{TARGET}'",
    code="code",
    context_block="case when context_code = '' then '' else "
    + filled(fixed.CONVERSION_CONTEXT, context="context_code") + " end",
)} as prompt, language, folder
 from segments join contexts using (repo, path, segment_no)
      join (select path, language, string_split(path, '/')[2] as folder from classified) using (path)"""


def oracle(name: str, *needed: str, body: str) -> None:
    """Register a query; the tables it derives from are added with what they need themselves."""
    import re

    wanted: list[str] = []

    def add(cte: str) -> None:
        for other in CTE:
            if other != cte and re.search(rf"\b(?:from|join)\s+{other}\b", CTE[cte]):
                add(other)
        if cte not in wanted:
            wanted.append(cte)

    for cte in needed:
        add(cte)
    # Texts and what is counted in them are derived once, however often they are read.
    once = {"blocks", "files", "pairs", "elements", "measured"}
    ctes = ", ".join(f"{w} as {'materialized ' if w in once else ''}({CTE[w]})" for w in wanted)
    kind = "with recursive" if "walk as" in body else "with"
    if body.lstrip().startswith(","):
        ORACLES[name] = f"{kind} {ctes}{body}"
    else:
        ORACLES[name] = f"{'with ' + ctes if ctes else ''} {body}"


# --- sources and sinks ------------------------------------------------------

oracle("scan_files", "files", body="""
 select repo, path, size, content from files
 where path not like '%/node_modules/%' and path not like '%/.git/%' """)
oracle("decode_text", "docs", body="select repo, path, content from docs")
oracle("write_converted", "converted", body="select source_path, output_path, target_folder, content from converted")
for _name in ("promote", "write_promoted"):
    oracle(_name, "reports", body="""
 select pair_id, converted_path, case when o_orderpriority = '5-LOW' then 'despite validation error'
        when overall_passed then 'validated' else 'with warnings' end as status
 from pairs join reports using (pair_id) join orders on o_orderkey = pair_id
 where (o_orderpriority <> '5-LOW' and overall_passed) or is_cross_language""")

# --- filters ----------------------------------------------------------------

SCANNED = ", ".join(f"'{e}'" for e in fixed.SCANNED_SUFFIXES)
oracle("filter_extension", "docs", body=f"""
 select repo, path, size from docs where '.' || string_split(path, '.')[-1] in ({SCANNED})""")
oracle("prune_dirs", "files", body="""
 select repo, path, size from files where path not like '%/node_modules/%' and path not like '%/.git/%' """)
oracle("filter_file_name", body="""
 select 'user' || user_id as repo, event_id || '/' || event_type || '.json' as path from events
 where event_type <> 'click' """)
oracle("filter_max_size", "docs", body="select repo, path, size from docs where size <= 4096")
oracle("filter_convertible", "classified", body="""
 select repo, path, language from classified where suffix <> '.rb' """)
oracle("files_without_segments", "files", body="""
 select repo, path from files where suffix not in ('.js', '.java', '.cpp')""")

# --- limits and order -------------------------------------------------------

oracle("truncate_lines", "docs", body=f"""
 select repo, path, size, breaks > {TEXT_LINES} or (breaks = {TEXT_LINES} and content not like '%' || chr(10)) as truncated,
        case when breaks > {TEXT_LINES} or (breaks = {TEXT_LINES} and content not like '%' || chr(10))
             then array_to_string(string_split(content, chr(10))[1:{TEXT_LINES}], chr(10)) || chr(10)
             else content end as content
 from (select *, length(content) - length(replace(content, chr(10), '')) as breaks from docs)""")
oracle("admit_within_budget", "files", body=f"""
, numbered as (select repo, path, size, row_number() over (partition by repo order by path) as n from files),
 walk as (
  select repo, n, path, size, size <= {SCAN_BYTES} as taken, case when size <= {SCAN_BYTES} then size else 0 end as total,
         case when size <= {SCAN_BYTES} then 1 else 0 end as count from numbered where n = 1
  union all
  select f.repo, f.n, f.path, f.size, w.total + f.size <= {SCAN_BYTES} and w.count < 100,
         w.total + case when w.total + f.size <= {SCAN_BYTES} and w.count < 100 then f.size else 0 end,
         w.count + case when w.total + f.size <= {SCAN_BYTES} and w.count < 100 then 1 else 0 end
  from walk w join numbered f on f.repo = w.repo and f.n = w.n + 1)
 select repo, path, size from walk where taken""")
oracle("limit_files", "files", body="""
 select repo, path, size from files qualify row_number() over (partition by repo order by path) <= 100""")
oracle("priority_queue", "doc_lines", "banded", body="""
 select repo, path, priority, cast(row_number() over (partition by repo order by priority, path) as integer) as queue_pos
 from banded""")
oracle("next_file", "doc_lines", "banded", body="""
 select repo, path, priority from banded
 qualify row_number() over (partition by repo order by priority, path) = 1""")

# --- scalar functions -------------------------------------------------------

oracle("classify_language", "classified", body="select repo, path, language from classified")
oracle("file_metrics", "doc_lines", body="""
 select repo, path, cast(len(lines) as integer) as loc, len(lines) / cast(100 as double) as complexity_score
 from doc_lines""")
oracle("priority_band", "doc_lines", "banded", body="select repo, path, loc, difficulty, priority from banded")
oracle("extension_for_language", "classified", body="""
 select repo, path, case suffix when '.rb' then '.txt' else suffix end as extension from classified""")
oracle("split_lines", "doc_lines", body="""
 select repo, path, cast(i - 1 as integer) as line_no, lines[i] as line
 from (select repo, path, lines, unnest(range(1, len(lines) + 1)) as i from doc_lines)""")
oracle("output_path", "files", body="""
 select repo, path, 'csharp/' || left(path, length(path) - length(suffix)) || '.cs' as output_path from files""")
oracle("build_conversion_prompt", "requested", body="select repo, path, segment_no, prompt from requested")
oracle("conversion_requests", "requested", body="select repo, path, segment_no, prompt from requested")
oracle("strip_code_fence", "attempts", body="select request_id, attempt_no, props as answer from attempts")
NAMES = {".py": "Python", ".js": "JavaScript", ".java": "Java", ".cpp": "C++", ".cs": "C#", ".sql": "sql",
         ".ts": "TypeScript", ".rb": "Ruby"}
NAME = "case " + "{0} " + " ".join(f"when '{k[1:]}' then '{v}'" for k, v in NAMES.items()) + " end"
oracle("build_review_prompt", "languages", body=f"""
 select pair_id, {filled(
    fixed.REVIEW_REQUEST,
    source_language=NAME.format("source_language"),
    target_language=NAME.format("target_language"),
    original_code="original_code",
    converted_code="converted_code",
)} as prompt from pairs join languages using (pair_id)""")
oracle("parse_verdict", "reviews", body="""
 select pair_id, case when text is null then false when text like 'Overall: PASS' then true
                      when text = 'unclear' then true else false end as passed from reviews""")
oracle("pair_languages", "languages", body="""
 select pair_id, source_language, target_language, is_cross_language from languages""")
# Lines of a class begin at its indentation, which is none; the Java class keeps its modifier.
oracle("slice_code", "segments", body="select repo, path, segment_no, code as code_chunk from segments")
oracle("preview", "doc_lines", body="""
 select repo, path,
        array_to_string(case when len(lines) <= 8 then lines else list_concat(lines[1:4],
            ['... (' || (len(lines) - 8) || ' lines omitted) ...'], lines[len(lines) - 3:len(lines)]) end, chr(10)) as as_segment,
        array_to_string(case when len(lines) <= 5 then lines else list_concat(lines[1:3],
            ['... (' || (len(lines) - 3) || ' lines omitted) ...']) end, chr(10)) as as_context
 from doc_lines""")
oracle("count_substring", "docs", body="""
 select repo, path, cast((length(content) - length(replace(content, 'an', ''))) // 2 as integer) as an,
        cast((length(content) - length(replace(content, '. ', ''))) // 2 as integer) as sentences from docs""")
oracle("json_path", body="""
 select event_id, props ->> '$.k' as k, 'default' as below_scalar, 'default' as missing from events""")

# --- lines, chunks, segments ------------------------------------------------

_LINES = """
 (select repo, path, parts, unnest(range(1, len(parts) + 1)) as i
  from (select repo, path, string_split(content, chr(10)) as parts from {0}))"""
_LINE_COLUMNS = """repo, path, cast(i as integer) as line_no,
        cast(sum(length(parts[i]) + 1) over (partition by path order by i) - length(parts[i]) - 1 as integer) as start_char,
        cast(length(regexp_extract(parts[i], '^[ \\t]*')) as integer) as indent, parts[i] as text,
        not regexp_matches(parts[i], '\\S') as is_blank"""
oracle("explode_lines", "files", body=f"""
 select {_LINE_COLUMNS}, regexp_matches(parts[i], '\\S') as is_code from {_LINES.format("files")}""")
oracle("explode_lines_of_text", "docs", body=f"select {_LINE_COLUMNS} from {_LINES.format('docs')}")
oracle("chunk_lines", "doc_lines", body=f"""
 select repo, path, cast(i as integer) as chunk_no,
        array_to_string(lines[i * {TEXT_LINES} + 1:i * {TEXT_LINES} + {TEXT_LINES}], chr(10)) as text
 from (select repo, path, lines, unnest(range(0, (len(lines) + {TEXT_LINES - 1}) // {TEXT_LINES})) as i from doc_lines)""")
oracle("join_chunks", "doc_lines", body="""
 select repo, path, array_to_string(lines, chr(10)) as content from doc_lines where len(lines) > 0""")
_SEGMENT = "repo, path, segment_no, node_type, name, code, start_char, end_char, start_line, end_line"
oracle("segment_python", "segments", body=f"select {_SEGMENT} from segments where suffix = '.py'")
oracle("segment_braced", "segments", body=f"select {_SEGMENT} from segments where suffix in ('.js', '.java', '.cpp')")
# The next closing brace is the one of the inner block: line four of seven.
oracle("segment_javascript_regex", "segments", body="""
 select repo, path, segment_no, 'FunctionOrClass' as node_type, name, left(code, strpos(code, '}')) as code, start_char,
        cast(start_char + strpos(code, '}') as integer) as end_char, start_line, cast(start_line + 3 as integer) as end_line
 from segments where suffix = '.js' """)
oracle("segment_whole_file", "segments", body=f"select {_SEGMENT} from segments where node_type = 'File' ")
oracle("segment_code", "segments", body=f"select {_SEGMENT} from segments")
oracle("extract_imports", "imports", body="select repo, path, kind, text, module, start_char from imports")
oracle("extract_modules", "imports", body="select distinct repo, path, module from imports")
oracle("modules_of_imports", "imports", body="select distinct repo, path, module from imports")
oracle("extract_calls", "calls", body="select * from calls")
oracle("extract_calls_with_keywords", "calls", body=f"""
 select * from calls
 union all
 select repo, path, 'f_' || l_partkey || '_' || l_linenumber as name, name || '(' as text, {_SITE.format(piece="'f_' || l_partkey")}
 from blocks where suffix in ('.py', '.js', '.java', '.cpp')
 union all
 select repo, path, 'if', 'if (', {_SITE.format(piece="'if ('")} from blocks where suffix = '.js' """)
oracle("extract_variables", "blocks", body="""
 select repo, path, case u when 2 then 'g_' || l_suppkey else 'x' end as name,
        cast(line + case u when 1 then 4 when 2 then 5 when 3 then 5 else 6 end as integer) as line_no
 from (select *, unnest([1, 2, 3, 4]) as u from blocks where suffix = '.py')""")
oracle("structural_elements", "elements", body="select pair_id, " + ", ".join(
    f"{s}_{f}" for s in ("original", "converted") for f in FIELDS) + " from elements")

# --- context and other joins ------------------------------------------------

_CONTEXT = """repo, path, segment_no, context_code, 0 as first_line,
        cast(case when context_code = '' then 0
             else length(context_code) - length(replace(context_code, chr(10), '')) + 1 end as integer) as last_line"""
oracle("definition_context", "contexts", body=f"select {_CONTEXT} from contexts where path like '%.py' ")
oracle("extract_context", "contexts", body=f"select {_CONTEXT} from contexts")
oracle("declaration_context", "segments", "imports", body=f"""
, heads as (
  select path, 1 as kind, start_char, statement as text from imports where suffix = '.js'
  union all select path, 2, start_char, 'function ' || name from segments where suffix = '.js'),
 found as (
  select s.repo, s.path, s.segment_no,
         coalesce(string_agg(h.text, chr(10) order by h.kind, h.start_char), '') as context_code
  from segments s left join heads h on h.path = s.path and h.start_char < s.start_char
  where s.suffix = '.js' group by s.repo, s.path, s.segment_no)
 select {_CONTEXT} from found""")
oracle("prefix_context", "segments", body=f"""
, found as (
  select s.repo, s.path, segment_no,
         trim(array_to_string(string_split(content, chr(10))[1:start_line], chr(10)), concat(' ', chr(10))) as context_code
  from segments s join files using (path))
 select {_CONTEXT} from found""")
# Whole lines of what ends on an earlier line: imports and definitions of earlier blocks, and the own import.
oracle("statement_context", "segments", "imports", body=f"""
, statements as (
  select path, start_char, start_line as first, end_line as last, repeat(' ', case node_type when 'class_definition' then 0
         else 4 end) || code as text from segments where suffix = '.py'
  union all select i.path, i.start_char, b.line, b.line, i.statement
  from imports i join blocks b on b.path = i.path and b.pos = i.start_char where i.suffix = '.py'),
 found as (
  select s.repo, s.path, s.segment_no, coalesce(string_agg(t.text, chr(10) order by t.first, t.last), '') as context_code
  from segments s left join statements t on t.path = s.path and t.last < s.start_line
  where s.suffix = '.py' group by s.repo, s.path, s.segment_no)
 select {_CONTEXT} from found""")
oracle("attach_responses", "responses", body="""
 select repo, path, segment_no, name, response from responses where response <> '' """)
oracle("unanswered_segments", "responses", body="select repo, path, segment_no, name from responses where response = '' ")
oracle("pair_converted", "converted", body="""
 select f.repo, path as original_path, f.content as original_code, output_path as converted_path,
        c.content as converted_code from files f join converted c on c.source_path = path""")
oracle("unconverted_files", "converted", body="""
 select repo, path, size from files where path not in (select source_path from converted)""")

# --- aggregates and reports -------------------------------------------------

oracle("language_stats", "classified", body="""
 select language, count(*) as files, cast(sum(loc) as bigint) as total_loc from classified group by language""")
oracle("language_files", "classified", body="select language, repo, path from classified")
CTE["per_file"] = """
 select repo, path, language, size, loc, coalesce(n, 0) as segments_count
 from classified left join (select path, cast(count(*) as integer) as n from segments group by path) using (path)"""
oracle("file_details", "per_file", body="""
 select *, case when path not like '%/pkg%' then 'not in a package' end as error from per_file""")
_STATS = """language, count(*) as files, cast(sum(segments_count) as bigint) as total_segments,
        cast(count(*) filter (segments_count > 0) as bigint) as files_with_segments"""
oracle("segment_stats", "per_file", body=f"select {_STATS} from per_file group by language")
oracle("node_type_distribution", "segments", body="""
 select node_type, count(*) as segments from segments group by node_type""")
oracle("with_share", "classified", body="""
 select language, count(*) as files, cast(sum(loc) as bigint) as total_loc,
        round(100.0 * count(*) / cast(sum(count(*)) over () as double), 1) as share from classified group by language""")
oracle("corpus_summary", "per_file", body="""
 select count(*) as total_files, cast(sum(loc) as bigint) as total_loc,
        cast(count(*) filter (segments_count > 0) as bigint) as files_with_segments,
        cast(sum(segments_count) as bigint) as total_segments,
        string_agg(distinct language, ',' order by language) as languages from per_file""")
oracle("run_summary", "converted", body="""
 select count(*) as files_processed, count(source_path) as files_converted,
        round(100.0 * count(source_path) / cast(count(*) as double), 1) as success_rate
 from files left join converted on source_path = path""")
oracle("assemble_files", "converted", body="""
 select repo, source_path, output_path, target_language, target_folder, content from converted""")
oracle("resolve_attempts", "attempts", body="""
 select request_id, coalesce(max(case when attempt_no = used and ok then props end), '') as text, used as attempts,
        cast(case used when 1 then 0 when 2 then 2 else 6 end as bigint) as backoff_seconds
 from attempts join (select request_id, coalesce(min(case when ok then attempt_no end), max(attempt_no)) as used
                     from attempts where attempt_no <= 3 group by request_id) using (request_id)
 group by request_id, used""")
oracle("pass_fail_counts", "verdicts", body="""
 select lenient_passed as passed, count(*) as results from verdicts group by lenient_passed""")
oracle("validation_matrix", "verdicts", body="""
 select pair_id, bool_or(lenient_passed) filter (validator = 'review') as review,
        bool_or(lenient_passed) filter (validator = 'semantic') as semantic,
        bool_or(lenient_passed) filter (validator = 'performance') as performance from verdicts group by pair_id""")

# --- graph ------------------------------------------------------------------

oracle("dependency_nodes", "imports", "calls", body="""
 select distinct module as id, 'module' as type, module as label from imports
 union all select distinct name, 'function', name from calls""")
oracle("dependency_nodes_by_file", "imports", "calls", body="""
 select repo, path, module as id, 'module' as type, module as label from (select distinct repo, path, module from imports)
 union all select repo, path, name, 'function', name from calls""")
oracle("dependency_edges", "imports", body="""
 select repo, path as "from", module as "to", 'imports' as type from imports""")
oracle("module_fan_in", "imports", body="""
 select module as "to", count(distinct path) as files from imports group by module
 order by files desc, module limit 25""")

# --- validation -------------------------------------------------------------

_METRIC_COLUMNS = "m.total_lines, m.non_empty_lines, m.functions, m.classes, m.control_structures"
for _name, _source in (("complexity_metrics", "files"), ("complexity_metrics_of_text", "docs")):
    _language = "string_split(path, '.')[-1]"
    oracle(_name, _source, body=f"""
 select repo, path, {_METRIC_COLUMNS}, round({_score("m")}, 4) as complexity_score
 from (select repo, path, {_metrics("content", _language)} as m from {_source})""")
oracle("complexity_check", "complexity", body="select pair_id, validator, passed, details from complexity")
oracle("structural_check", "structure", body="select pair_id, validator, passed, details from structure")
oracle("normalised_source_check", "languages", body=f"""
 select pair_id, 'semantic' as validator, kind < 2 as passed,
        case when kind < 2 then '{fixed.SOURCES_MATCH}' when kind = 2 then '{fixed.SOURCES_DIFFER}'
             else '{fixed.SOURCES_ERROR.format(error="brackets do not pair")}' end as details
 from (select *, (pair_id // 32) % 4 as kind from languages where source_language = 'py' and target_language = 'py')""")
oracle("runtime_check", "timings", body=f"""
 select l_orderkey, l_partkey, l_suppkey, l_linenumber, 'performance' as validator,
        {RUN_PASSED} as passed, {RUN_DETAILS} as details from timings""")
oracle("verdict_check", "reviews", body=f"""
 select pair_id, 'review' as validator, {REVIEW_PASSED} as passed, {REVIEW_DETAILS} as details from reviews""")
# Reviews of orders without line items have no pair, hence no language, and are left as they are.
oracle("apply_leniency", "languages", "pair_reviews", body=f"""
 select pair_id, 'review' as validator, passed or hit as passed,
        case when hit and not passed then 'Cross-language conversion: ' || details else details end as details
 from (select pair_id, {REVIEW_PASSED} as passed, {REVIEW_DETAILS} as details,
              coalesce(is_cross_language, false) and lower(details) like '%language-specific%' as hit
       from pair_reviews left join languages using (pair_id))""")
oracle("overall_verdict", "structure", "complexity", body="""
 select pair_id, is_cross_language, case when is_cross_language then count_if(passed) >= 2 else bool_and(passed) end
        as overall_passed
 from (select * from structure union all select * from complexity) join languages using (pair_id)
 group by pair_id, is_cross_language""")
oracle("run_validators", "verdicts", body="""
 select pair_id, validator, lenient_passed as passed, lenient_details as details from verdicts""")
oracle("validation_reports", "reports", body="""
 select pair_id, overall_passed, is_cross_language, false as strict_mode, validators from reports""")
oracle("validation_reports_strict", "verdicts", body="""
 select pair_id, bool_and(passed) as overall_passed, is_cross_language, true as strict_mode,
        cast(count(*) as integer) as validators
 from verdicts where validator <> 'review' group by pair_id, is_cross_language""")

# --- whole flows ------------------------------------------------------------

# Joining chunks takes the final line break off whole files; inside functions there is none.
oracle("corpus_to_requests", "requested", body=f"""
 select repo, path, segment_no, case when path like '%.cs' or path like '%.sql' or path like '%.ts'
        then replace(prompt, concat(chr(10), chr(10), '### END'), concat(chr(10), '### END')) else prompt end as prompt
 from requested where language <> 'unknown' and folder not in ('node_modules', '.git')""")
_SCANNED = "path not like '%/node_modules/%' and path not like '%/.git/%'"
oracle("corpus_report_languages", "classified", body=f"""
 select language, count(*) as files, cast(sum(loc) as bigint) as total_loc,
        round(100.0 * count(*) / cast(sum(count(*)) over () as double), 1) as share
 from classified where {_SCANNED} group by language""")
oracle("corpus_report_details", "per_file", body=f"""
 select *, cast(null as varchar) as error from per_file where {_SCANNED}""")
oracle("corpus_report_summary", "per_file", body=f"""
 select count(*) as total_files, cast(sum(loc) as bigint) as total_loc,
        cast(count(*) filter (segments_count > 0) as bigint) as files_with_segments,
        cast(sum(segments_count) as bigint) as total_segments,
        string_agg(distinct language, ',' order by language) as languages from per_file where {_SCANNED}""")
oracle("corpus_report_segments", "per_file", body=f"""
 select {_STATS} from per_file where path not like '%/node_modules/%' and path not like '%/.git/%' group by language""")
oracle("corpus_report_node_types", "segments", body="""
 select node_type, count(*) as segments, round(100.0 * count(*) / cast(sum(count(*)) over () as double), 1) as share
 from segments where path not like '%/node_modules/%' and path not like '%/.git/%' group by node_type""")
