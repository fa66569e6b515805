"""SQL of the detectors that walk a file, for an engine with lists, lambdas and RE2.

Each says the rule another way than the detector: tokens and folds over lists in place of walks in Python.
They hold on the synthetic corpus; nested templates in strings and doc comments, which it has none of, are
not followed.
"""

from __future__ import annotations

from codesieve.functions.text import match_lines_sql, re2
from codesieve.operators import fixes, imports, narrative, quality, security
from codesieve.sources.corpus import JS

_JS = ", ".join(map(repr, JS))
_TRIM = re2(r"^\s+|\s+$")
_HEAD = 'project, path AS "filePath"'


def row(engine: str, rule: str, severity: str, message: str, help: str, line: str, category: str, fixable: str = "false") -> str:
    return f"SELECT {_HEAD}, '{engine}' AS engine, {rule} AS rule, {severity} AS severity, {message} AS message, '{help}' AS help, {line} AS line, CAST(0 AS BIGINT) AS \"column\", '{category}' AS category, {fixable} AS fixable "


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {_TRIM}, '', 'g')"


def _hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {re2(pattern)})"


def _starts(x: str, pattern) -> str:
    """Whether a text begins with what a Python pattern matches."""
    return f"regexp_matches({x}, '^(?:' || {_source(pattern)} || ')')"


def _source(pattern) -> str:
    return "'" + pattern.pattern.replace("'", "''").replace("(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))", r"\b") + "'"


# Unused imports: statements from a line that begins one to the line that says from where.
IMPORTS = f"""trimmed AS (SELECT project, path, ext, string_split(content, chr(10)) AS raw, list_transform(string_split(content, chr(10)), lambda x: {_trim('x')}) AS t FROM files WHERE ext IN ({_JS}, '.py')),
begun AS (SELECT *, unnest(list_filter(range(1, len(t) + 1), lambda i: CASE WHEN ext = '.py' THEN {_starts('t[i]', imports.PY_FROM)} OR {_starts('t[i]', imports.PY_IMPORT)} ELSE starts_with(t[i], 'import ') END)) AS i FROM trimmed),
spans AS (SELECT *, CASE WHEN ext = '.py' OR {_starts('t[i]', imports.NO_NAMES)} THEN i ELSE coalesce(list_min(list_filter(range(i, len(t) + 1), lambda k: contains(t[k], 'from'))), len(t)) END AS j FROM begun),
statements AS (SELECT *, array_to_string(t[i:j], ' ') AS w, NOT (ext <> '.py' AND {_starts('t[i]', imports.NO_NAMES)}) AS named FROM spans),
items AS (SELECT project, path, i, unnest(CASE WHEN NOT named THEN []
    WHEN ext = '.py' AND {_starts('t[i]', imports.PY_FROM)} THEN list_transform(string_split(regexp_replace(regexp_replace(regexp_extract(t[i], {_source(imports.PY_FROM)}, 1), '#.*$', ''), '[()]', '', 'g'), ','), lambda x: trim(x))
    WHEN ext = '.py' THEN [string_split(coalesce(nullif(regexp_extract(t[i], {_source(imports.PY_IMPORT)}, 2), ''), regexp_extract(t[i], {_source(imports.PY_IMPORT)}, 1)), '.')[1]]
    WHEN regexp_matches(w, {_source(imports.NAMESPACE)}) THEN [regexp_extract(w, {_source(imports.NAMESPACE)}, 1)]
    ELSE list_concat(list_filter([regexp_extract(w, {_source(imports.DEFAULT)}, 1)], lambda x: x NOT IN ('', 'type')), list_filter(list_transform(string_split(regexp_extract(w, {_source(imports.NAMED)}, 1), ','), lambda x: trim(x)), lambda x: x <> '')) END) AS item FROM statements),
locals AS (SELECT project, path, i, regexp_replace(CASE WHEN regexp_matches(item, '\\s+as\\s+') THEN regexp_extract(item, '\\s+as\\s+(.*)$', 1) ELSE item END, '^type\\s+', '') AS name FROM items),
taken AS (SELECT project, path, list_distinct(flatten(list(range(i, j + 1)))) AS gone FROM spans GROUP BY ALL),
rest AS (SELECT project, path, array_to_string(list_transform(list_filter(range(1, len(raw) + 1), lambda k: NOT list_contains(gone, k)), lambda k: raw[k]), chr(10)) AS rest FROM trimmed JOIN taken USING (project, path))"""
UNUSED = row("ai-slop", "'ai-slop/unused-import'", "'warning'", "'Imported symbol ''' || name || ''' is never used'", "Remove the import", "CAST(i AS BIGINT)", "AI Slop", "true") + "FROM locals JOIN rest USING (project, path) WHERE regexp_full_match(name, '[A-Za-z0-9_]+') AND NOT contains(rest, name)"

# Narrative comments: islands of commented lines.
_MARKED = "CASE WHEN ext IN ('.py', '.rb') THEN starts_with(ltrim(raw), '#') AND NOT starts_with(ltrim(raw), '#!') ELSE starts_with(ltrim(raw), '//') END"
_DECLARES = f"coalesce({_starts('after', narrative.DECLARES)} OR CASE " + " ".join(f"WHEN ext = '{e}' THEN {_starts('after', p)}" for e, p in narrative.DECLARES_BY.items()) + " ELSE false END, false)"
_any = lambda name, pattern: f"len(list_filter({name}, lambda x: {_starts('x', pattern)})) > 0"
_search = lambda text, pattern: f"regexp_matches({text}, {_source(pattern)})"
_REASON = f"""CASE WHEN first = 1 AND (contains(lower(array_to_string(raw, ' ')), 'copyright') OR contains(lower(array_to_string(raw, ' ')), 'license')) THEN NULL
    WHEN len(list_filter(raw, lambda x: {_search('x', narrative.DIRECTIVE)})) > 0 THEN NULL
    WHEN {_any('prose', narrative.SEPARATOR)} THEN 'decorative separator' WHEN {_any('prose', narrative.SECTION)} THEN 'phase/section header'
    WHEN len(prose) = 1 AND {_starts('prose[1]', narrative.LABEL)} AND len(list_filter(string_split(prose[1], ' '), lambda x: x <> '')) <= 3 AND NOT coalesce({_starts('after', narrative.DATA)}, false) THEN 'bare section label'
    WHEN len(prose) >= 3 AND {_DECLARES} THEN 'multi-line preamble before declaration' WHEN {_search("array_to_string(prose, ' ')", narrative.REFERENCES)} THEN 'cross-reference commentary'
    WHEN {_any('prose', narrative.JUSTIFIES)} THEN 'justification prose' WHEN len(raw) = 1 AND {_starts('prose[1]', narrative.EXPLAINS)} AND {_DECLARES} THEN 'explanatory preamble'
    WHEN len(list_filter(prose, lambda x: x <> '')) >= 5 THEN 'long narrative block'
    WHEN len(list_filter(prose, lambda x: x <> '')) >= 3 AND NOT {_search("array_to_string(prose, ' ')", narrative.WHY)} THEN 'multi-line narrative prose' END"""
NARRATIVE = f"""islands AS (SELECT *, line - row_number() OVER (PARTITION BY project, path ORDER BY line) AS island FROM (SELECT project, path, ext, line, raw FROM lines) WHERE {_MARKED}),
told AS (SELECT project, path, ext, min(line) AS first, max(line) AS last, list(raw ORDER BY line) AS raw, list(regexp_replace(raw, '^[ \\t]*(?://|#)\\s?', '') ORDER BY line) AS prose FROM islands GROUP BY project, path, ext, island),
followed AS (SELECT t.*, list_filter(string_split(content, chr(10))[last + 1:], lambda x: {_trim('x')} <> '')[1] AS after FROM told t JOIN files USING (project, path)),
narrated AS (SELECT *, {_REASON} AS why FROM followed)"""
NARRATED = row("ai-slop", "'ai-slop/narrative-comment'", "'warning'", "'Narrative comment block (' || why || ')'", "Remove the comment", "CAST(first AS BIGINT)", "Comments", "true") + "FROM narrated WHERE why IS NOT NULL"

# Risky constructs: the mask by tokens.
_SQ = "''"
_blank = lambda x: f"regexp_replace({x}, '[^\\n]', ' ', 'g')"
_quoted = lambda q: f'{q}(?:\\\\[\\s\\S]|[^\\\\{q}\\n])*{q}?'
_JS_TOKENS = rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|{_quoted(chr(34))}|{_quoted(_SQ)}|`(?:\\[\s\S]|[^\\`])*`?|[^\"{_SQ}`/]+|/"
_PY_TOKENS = rf'"""[\s\S]*?(?:"""|\z)|{_SQ * 3}[\s\S]*?(?:{_SQ * 3}|\z)|{_quoted(chr(34))}|{_quoted(_SQ)}|#[^\n]*|[^\"{_SQ}#]+'
_string = f"CASE WHEN len(x) > 1 THEN x[1] || {_blank('x[2:len(x) - 1]')} || x[len(x)] ELSE x END"
_masked_token = lambda comments: f"""CASE WHEN {' OR '.join(f"starts_with(x, '{c}')" for c in comments)} THEN {_blank('x')} WHEN starts_with(x, '\"\"\"') OR starts_with(x, '{_SQ * 3}') THEN x[1:3] || {_blank('x[4:len(x) - 3]')} || x[len(x) - 2:]
    WHEN starts_with(x, '`') THEN '`' || array_to_string(list_transform(regexp_extract_all(x[2:len(x) - 1], '\\$\\{{[^}}]*\\}}|[^$]+|\\$'), lambda y: CASE WHEN starts_with(y, '${{') THEN y ELSE {_blank('y')} END), '') || x[len(x)]
    WHEN starts_with(x, '"') OR starts_with(x, '{_SQ}') THEN {_string} ELSE x END"""  # noqa: E731
MASKED = f"""masked AS (SELECT project, path, ext, CASE WHEN ext = '.py' THEN array_to_string(list_transform(regexp_extract_all(content, '{_PY_TOKENS}'), lambda x: {_masked_token(['#'])}), '')
    WHEN ext IN ({_JS}) THEN array_to_string(list_transform(regexp_extract_all(content, '{_JS_TOKENS}'), lambda x: {_masked_token(['//', '/*'])}), '') ELSE content END AS code FROM files)"""
_risky = " UNION ALL ".join(
    f"SELECT project, path, {k} AS k, unnest({match_lines_sql('code', p)}) AS s FROM masked WHERE ext IN ({', '.join(map(repr, e))}) AND {_hit('code', p)}" + (f" AND NOT {_hit('path', security.MIGRATIONS)}" if name == "sql-injection" else "")
    for k, (name, e, p, _) in enumerate(security.RISKY)
)
_case = lambda values: "CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"
RISKY = row("security", "'security/' || " + _case([r[0] for r in security.RISKY]), "'error'", _case([r[3] for r in security.RISKY]), "Use a safe alternative", "s.line", "Security") + f"FROM ({_risky})"

# Duplicate blocks: a fold over the repeated windows of a file.
WINDOWS = f"""ws AS (SELECT project, path, CAST(i AS BIGINT) AS line, ls[i:i+9] AS raw, list_transform(ls[i:i+9], lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, {re2(quality.LITERALS)}, '"L"', 'g'), {re2(r'\b\d+(?:\.\d+)?\b')}, '0', 'g'), {re2(r'\s+')}, ' ', 'g'))) AS norm
    FROM (SELECT project, path, ls, unnest(generate_series(1, len(ls) - 9)) AS i FROM (SELECT project, path, string_split(content, chr(10)) AS ls FROM files WHERE lower(ext) IN ({_JS})) WHERE len(ls) >= 10)),
kept AS (SELECT project, path, line, array_to_string(norm, chr(10)) AS key FROM ws WHERE len(list_filter(norm, lambda x: x = '')) = 0
    AND len(list_filter(raw, lambda x: regexp_matches({_trim('x')}, '^(//|/\\*|\\*)|^$|^[{{}}]$|^\\}}\\);$|^\\}},$'))) < 10
    AND len(list_filter(norm, lambda x: x NOT IN ('', '{{', '}}'))) >= 9 AND len(list_distinct(norm)) >= 7),
repeated AS (SELECT * FROM (SELECT project, path, line, min(line) OVER (PARTITION BY project, path, key) AS prior FROM kept) WHERE line - prior >= 10)"""
BLOCKS = """blocks AS (SELECT project, path, unnest(list_reduce(list([{'line': line, 'prior': prior, 'span': CAST(10 AS BIGINT)}] ORDER BY line), lambda s, x: CASE WHEN len(list_filter(s, lambda b: b.prior = x[1].prior)) > 0 THEN s
    WHEN x[1].line - s[len(s)].line < 10 AND x[1].prior - s[len(s)].prior < 10 THEN list_append(s[1:len(s) - 1], {'line': s[len(s)].line, 'prior': s[len(s)].prior, 'span': greatest(s[len(s)].span, x[1].line + 10 - s[len(s)].line)})
    ELSE list_concat(s, x) END)) AS b FROM repeated GROUP BY project, path)"""
DUPLICATES = row("code-quality", "'code-quality/duplicate-block'", "'warning'", "b.span || '-line block at line ' || b.line || ' duplicates a block starting at line ' || b.prior || '. Extract a shared helper.'", "Share one function", "b.line", "Complexity") + "FROM blocks"

# Functions: a fold over the braces (or indents) that follow a first line.
_which = "CASE " + " ".join(f"WHEN ext IN ({', '.join(map(repr, e))}) AND regexp_matches(x, {re2(p)}) THEN {k}" for k, (e, p) in enumerate(quality.FUNCTIONS)) + " ELSE -1 END"
_group = lambda n: "CASE k " + " ".join(f"WHEN {k} THEN regexp_extract(ls[i], {re2(p)}, {n})" for k, (_, p) in enumerate(quality.FUNCTIONS)) + " END"
_opens = r"""(regexp_matches(ls[i], '=>\s*\{') OR (regexp_matches(ls[i], '=>\s*$') AND coalesce(regexp_matches(ls[i + 1], '^\s*\{'), false)) OR
    coalesce(CASE WHEN trim(ls[i + 1]) = '' OR regexp_matches(ltrim(ls[i + 1]), STATEMENT) THEN false WHEN regexp_matches(ls[i + 1], '=>\s*\{|^\s*\{') THEN true WHEN trim(ls[i + 2]) = '' OR regexp_matches(ltrim(ls[i + 2]), STATEMENT) THEN false ELSE regexp_matches(ls[i + 2], '=>\s*\{|^\s*\{') END, false))""".replace("STATEMENT", r"'^(?:export\s+)?(?:const|let|var|function|class)\s'")
_state = "'depth': {}, 'begun': {}, 'stack': {}, 'deepest': {}, 'last': {}, 'done': {}"
_token = "{'j': j, 'c': C, 'control': X, " + _state.format("0", "-1", "[]::BOOLEAN[]", "0", "CAST(0 AS BIGINT)", "false") + "}"
_tokens = f"""flatten(list_transform(range(i, len(ls) + 1), lambda j: list_concat(list_transform(range(1, len(regexp_extract_all(ls[j], '[{{}}]')) + 1), lambda m: {_token.replace('C', "regexp_extract_all(ls[j], '[{}]')[m]", 1).replace('X', "regexp_matches(rtrim(string_split_regex(ls[j], '[{}]')[m]), '(?:\\)|=>|\\b(?:else|try|finally|do))$')", 1)}),
    [{_token.replace("C", "'end'", 1).replace('X', 'false', 1)}])))"""
_head = "{'j': CAST(i AS BIGINT), 'c': 'start', 'control': false, " + _state.format("0", "-1", "[]::BOOLEAN[]", "0", "CAST(0 AS BIGINT)", "false") + "}"
_same = "'j': x.j, 'c': x.c, 'control': x.control, "
_fold = f"""lambda s, x: CASE WHEN s.done THEN s
    WHEN x.c = 'end' THEN {{{_same}{_state.format('s.depth', 's.begun', 's.stack', 's.deepest', 'x.j', 's.begun >= 0 AND s.depth < s.begun AND x.j > i')}}}
    WHEN x.c = '}}' THEN {{{_same}{_state.format('s.depth - 1', 's.begun', 's.stack[1:len(s.stack) - 1]', 's.deepest', 's.last', 'false')}}}
    ELSE {{{_same}{_state.format('s.depth + 1', 'CASE WHEN s.begun < 0 THEN s.depth + 1 ELSE s.begun END', 'list_append(s.stack, s.begun >= 0 AND x.control)', 'CASE WHEN s.begun >= 0 AND x.control THEN greatest(s.deepest, CAST(len(list_filter(s.stack, lambda y: y)) + 1 AS INTEGER)) ELSE s.deepest END', 's.last', 'false')}}} END"""
_indent = lambda x: f"(len({x}) - len(ltrim({x})))"
_control = r"'^\s*(?:if|for|while|with|try|except|else|elif|finally|def|class)\b'"
FUNCTIONS = f"""firsts AS (SELECT project, path, ext, ls, unnest(list_filter(list_transform(ls, lambda x, i: {{'i': i, 'k': {_which}}}), lambda y: y.k >= 0)) AS f FROM (SELECT project, path, lower(ext) AS ext, string_split(content, chr(10)) AS ls FROM files)),
named AS (SELECT project, path, ls, i, k, {_group(1)} AS name, {_group(2)} AS listed FROM (SELECT project, path, ls, f.i AS i, f.k AS k FROM firsts) WHERE k <> 1 OR {_opens}),
braced AS (SELECT project, path, ls, i, k, name, listed, list_reduce({_tokens}, {_fold}, {_head}) AS s FROM named WHERE k <> 2),
bodies AS (SELECT *, coalesce(list_min(list_filter(range(i + 1, len(ls) + 1), lambda j: trim(ls[j]) <> '' AND {_indent('ls[j]')} <= {_indent('ls[i]')})), len(ls) + 1) - 1 AS e FROM named WHERE k = 2),
indented AS (SELECT *, list_transform(list_filter(range(i + 1, e + 1), lambda j: trim(ls[j]) <> ''), lambda j: {{'own': {_indent('ls[j]')}, 'control': regexp_matches(ls[j], {_control}), 'stack': []::BIGINT[], 'deepest': 0}}) AS body FROM bodies),
nested AS (SELECT *, list_reduce(body, lambda s, x: CASE WHEN x.control THEN {{'own': x.own, 'control': x.control, 'stack': list_append(list_filter(s.stack, lambda y: y < x.own), x.own), 'deepest': greatest(s.deepest, CAST(len(list_filter(s.stack, lambda y: y < x.own)) + 1 AS INTEGER))}}
    ELSE {{'own': x.own, 'control': x.control, 'stack': list_filter(s.stack, lambda y: y < x.own), 'deepest': s.deepest}} END, {{'own': CAST(0 AS BIGINT), 'control': false, 'stack': []::BIGINT[], 'deepest': 0}}) AS s FROM indented),
ended AS (SELECT project, path, ls, i, name, listed, true AS braces, CASE WHEN s.begun < 0 THEN i ELSE s.last END AS e, CASE WHEN s.begun < 0 THEN 0 ELSE s.deepest END AS nesting FROM braced
    UNION ALL SELECT project, path, ls, i, name, listed, false, e, s.deepest FROM nested),
functions AS (SELECT project, path, name, CAST(i AS BIGINT) AS line, CAST(e - i + 1 AS BIGINT) AS lines, CAST(nesting AS BIGINT) AS nesting, CAST(CASE WHEN trim(listed) = '' THEN 0 ELSE len(string_split(listed, ',')) END AS BIGINT) AS params,
    CAST(CASE WHEN braces THEN len(list_filter(range(i + 1, e), lambda p: len(regexp_replace(regexp_replace(array_to_string(ls[i + 1:p - 1], chr(10)), '\\\\.?', '', 'g'), '[^`]', '', 'g')) % 2 = 1)) ELSE 0 END AS BIGINT) AS template_lines FROM ended)"""
COMPLEX = " UNION ALL ".join(
    row("code-quality", f"'complexity/{rule}'", "'warning'", f"'Function ''' || name || ''' has ' || {message}", "Split the function", "line", "Complexity") + f"FROM functions WHERE {where}"
    for rule, message, where in (
        ("function-too-long", "lines || ' lines (max: 80)'", "lines - template_lines > 88"),
        ("deep-nesting", "'nesting depth ' || nesting || ' (max: 5)'", "nesting > 5"),
        ("too-many-params", "params || ' parameters (max: 6)'", "params > 6"),
    )
)

# Fixes: each step gives files (project, path, ext, content) that the next one reads under the same name.
_ERRORS = f"regexp_matches(array_to_string(ls[i:e], chr(10)), {_source(fixes.ERRORS)})"
_balance = lambda x: f"(len(replace({x}, '(', '((')) - len({x})) - (len(replace({x}, ')', '))')) - len({x}))"
LEFTOVERS = f"""marked AS (SELECT "filePath" AS path, project, line, rule FROM ({{rules}})),
statement AS (SELECT m.*, string_split(f.content, chr(10)) AS ls, CAST(line AS BIGINT) AS i FROM marked m JOIN files f USING (project, path)),
spanned AS (SELECT *, CASE WHEN rule <> 'ai-slop/console-leftover' THEN i ELSE coalesce(list_min(list_filter(range(i, len(ls) + 1), lambda k: contains(array_to_string(ls[i:k], ''), '(') AND {_balance("array_to_string(ls[i:k], '')")} <= 0)), len(ls)) END AS e FROM statement),
edits AS (SELECT project, path, list_distinct(flatten(list(CASE WHEN rule = 'ai-slop/console-leftover' AND {_ERRORS} THEN []::BIGINT[] ELSE range(i, e + 1) END))) AS gone,
    coalesce(list(i) FILTER (rule = 'ai-slop/console-leftover' AND {_ERRORS}), []::BIGINT[]) AS errors FROM spanned GROUP BY project, path),
left_lines AS (SELECT project, path, ext, list_filter(list_transform(string_split(content, chr(10)), lambda x, i: {{{{'i': i, 'x': CASE WHEN list_contains(coalesce(errors, []), i) THEN regexp_replace(x, {_source(fixes.CONSOLE)}, 'console.error(') ELSE x END}}}}), lambda y: NOT list_contains(coalesce(gone, []), y.i)) AS kept FROM files LEFT JOIN edits USING (project, path)),
without_leftovers AS (SELECT project, path, ext, CASE WHEN edits.gone IS NULL THEN content ELSE array_to_string(list_transform(list_filter(range(1, len(kept) + 1), lambda k: trim(kept[k].x) <> '' OR k = 1 OR trim(kept[k - 1].x) <> ''), lambda k: kept[k].x), chr(10)) END AS content FROM left_lines JOIN files USING (project, path, ext) LEFT JOIN edits USING (project, path))"""
WITHOUT_NARRATIVE = f"""gone_lines AS (SELECT project, path, list_distinct(flatten(list(list_concat(range(CAST(first AS BIGINT), CAST(last AS BIGINT) + 1), CASE WHEN first >= 2 AND trim(ls[first - 1]) = '' AND last < len(ls) AND trim(ls[last + 1]) = '' THEN [CAST(first - 1 AS BIGINT)] ELSE []::BIGINT[] END)))) AS gone
    FROM (SELECT n.*, string_split(f.content, chr(10)) AS ls FROM narrated n JOIN files f USING (project, path) WHERE why IS NOT NULL) GROUP BY project, path),
without_narrative AS (SELECT project, path, ext, CASE WHEN gone IS NULL THEN content ELSE array_to_string(list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda x, i: {{'i': i, 'x': x}}), lambda y: NOT list_contains(gone, y.i)), lambda y: y.x), chr(10)) END AS content FROM files LEFT JOIN gone_lines USING (project, path))"""
WITHOUT_IMPORTS = """judged AS (SELECT project, path, i, bool_and(NOT contains(rest, name)) AS unused FROM locals JOIN rest USING (project, path) WHERE regexp_full_match(name, '[A-Za-z0-9_]+') GROUP BY ALL),
gone_imports AS (SELECT project, path, flatten(list(range(i, j + 1))) AS gone FROM judged JOIN spans USING (project, path, i) WHERE unused GROUP BY ALL),
cut AS (SELECT project, path, ext, list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda x, i: {'i': i, 'x': x}), lambda y: NOT list_contains(gone, y.i)), lambda y: y.x) AS ls FROM files JOIN gone_imports USING (project, path)),
without_imports AS (SELECT project, path, ext, array_to_string(ls[coalesce(list_min(list_filter(range(1, len(ls) + 1), lambda k: trim(ls[k]) <> '')), len(ls) + 1):], chr(10)) AS content FROM cut UNION ALL SELECT project, path, ext, content FROM files ANTI JOIN gone_imports USING (project, path))"""


def fixed_sql(corpus: str, lines: str, rules: str) -> str:
    """The files after all three steps."""
    first = f"WITH {corpus},\n{lines},\n{LEFTOVERS.format(rules=rules)}\nSELECT * FROM without_leftovers"
    second = f"WITH files AS (SELECT * FROM ({first})),\n{lines},\n{NARRATIVE},\n{WITHOUT_NARRATIVE}\nSELECT * FROM without_narrative"
    return f"WITH files AS (SELECT * FROM ({second})),\n{IMPORTS},\n{WITHOUT_IMPORTS}\nSELECT * FROM without_imports"
