"""The queries once more, as plain SQL for DuckDB over ``documents`` and ``events``.

Each entry of ``tables()`` is one common table expression; a query's statement
is its entry with the entries it refers to in front.  Word lists and patterns
come from the same fixed values as the operators, the logic does not.
"""

from __future__ import annotations

import re
from functools import cache

from codestrata import rules as R
from codestrata.sources.corpus import fixture_templates

WS = " \t\n\x0b\x0c\r"
BREAK = "[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
NL, ON, OFF = "chr(10)", "chr(1)", "chr(2)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {q(WS)})"


def lines(x: str) -> str:
    return (
        f"case when {x} = '' then []::varchar[] "
        f"else string_split_regex(regexp_replace({x}, {q(BREAK + chr(92) + 'z')}, ''), {q(BREAK)}) end"
    )


def case(pairs, otherwise: str = "null") -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {otherwise} end"


def hits(source: str, pattern: str, extra: str) -> str:
    """Every match with the line it starts on; ``extra`` adds constant columns."""
    return f"""
      select repo, path, {extra}, cast(1 + coalesce(before, 0) as bigint) as line, split_part(seg, {OFF}, 1) as m
      from (select *, sum(length(seg) - length(replace(seg, {NL}, ''))) over (partition by repo, path order by i
                rows between unbounded preceding and 1 preceding) as before
            from (select repo, path, unnest(segs) as seg, generate_subscripts(segs, 1) as i
                  from (select repo, path, string_split(regexp_replace(content, {q(pattern)},
                          {ON} || '\\0' || {OFF}, 'g'), {ON}) as segs
                        from {source} where regexp_matches(content, {q(pattern)}))))
      where i > 1"""


def groups(source: str, pattern: str, fields: list[str], where: str = "true") -> str:
    """One row per match with its groups as columns."""
    lists = ", ".join(f"unnest(regexp_extract_all(content, {q(pattern)}, {i + 1})) as {f}" for i, f in enumerate(fields))
    return f"select repo, path, has_docstring, parts, {lists} from {source} where {where}"


def union(parts) -> str:
    return "\nunion all\n".join(f"({p})" for p in parts)


def ladder(x: str, steps, last: str, op: str) -> str:
    return case([(f"{x} {op} {b}", q(label)) for b, label in steps], q(last))


def root_text(name: str) -> str:
    return f"max(case when path = {q(name)} then content end)"


def toml(x: str, header: str) -> str:
    """Body of a TOML section: cut before each header line."""
    mark = q(r"(?m)^[ \t]*\[+([^\[\]\n=,]+)\]+[ \t]*(?:#[^\n]*)?$")
    cut = f"string_split(regexp_replace({x}, {mark}, {ON} || '\\1' || {OFF}, 'g'), {ON})"
    return f"(list_filter({cut}[2:], lambda s: {strip('split_part(s, chr(2), 1)')} = {q(header)}))[1]"


def spec_columns(spec: str) -> tuple[str, str]:
    bare = strip(f"regexp_replace({spec}, {q(chr(92) + '[[^' + chr(10) + ']*?' + chr(92) + ']')}, '', 'g')")
    fits = f"regexp_matches({bare}, {q(R.SPEC)})"
    version = strip(f"ltrim({strip(f'regexp_extract({bare}, {q(R.SPEC)}, 2)')}, '=')")
    return (
        f"case when {fits} then regexp_extract({bare}, {q(R.SPEC)}, 1) else {bare} end",
        f"case when {fits} then {version} else '' end",
    )


def status(name: str, version: str) -> str:
    digits = f"regexp_extract({version}, '(\\d+)', 1)"
    major = f"try_cast({digits} as bigint)"
    behind = " or ".join(
        f"(lower({name}) = {q(k)} and {major} < {v - 1})" for k, v in R.STABLE_MAJOR.items() if v > 0
    )
    early = f"({major} = 0 and (contains({version}, '==') or starts_with({version}, '0')) and lower({name}) in {among(R.PAST_V1)})"
    return f"case when {digits} = '' then 'unknown' when {behind} or {early} then 'outdated' else 'ok' end"


def unknown(x: str) -> str:
    return f"case when {x} = '' then 'unknown' else {x} end"


@cache
def tables() -> dict[str, str]:
    t: dict[str, str] = {}
    template_rows = ", ".join(f"({a}, {k}, {q(p)}, {q(b)})" for a, k, p, b in fixture_templates())

    # --- corpus
    t["t_templates"] = f"select * from (values {template_rows}) v(arch, k, path, body)"
    t["t_documents"] = """select *, cast(floor(n / 12.0) as int) as g, ri % 5 as arch from (
        select source as repo, coalesce(text, '') as text, cast(substr(source, 4) as int) as ri,
               row_number() over (partition by source order by doc_id) - 1 as n from documents)"""

    def files_at(slot: str) -> str:
        return f"""select *, cast(strlen(content) as bigint) as size_bytes from (
        select e.repo, e.n,
          concat(case when g = 0 then '' else concat('pkg', cast(g as varchar), '/') end, t.path) as path,
          replace(replace(replace(replace(replace(replace(replace(t.body, '{{nn}}', lpad(cast(n % 100 as varchar), 2, '0')),
            '{{n}}', cast(n as varchar)), '{{hashed}}', replace(text, chr(10), concat(chr(10), '# '))),
            '{{slashed}}', replace(text, chr(10), concat(chr(10), '// '))),
            '{{json}}', replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'),
              chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')), '{{text}}', text),
            '{{words}}', concat('# ', replace(text, ' ', concat(chr(10), '# ')))) as content
        from t_documents e join t_templates t on t.arch = e.arch and t.k = {slot})"""

    t["t_all_files"] = files_at("e.n % 12")
    for shift, state in enumerate(["later", "third", "fourth", "fifth"], 1):
        t[f"t_{state}_files"] = files_at(f"(e.n + {shift}) % 12")
    t["t_files"] = "select * from t_all_files"
    t["t_commits"] = """select concat('src', cast(event_id % 20 as varchar)) as repo, event_id as commit_id,
        concat('user', cast(user_id as varchar)) as author_name,
        concat('user', cast(user_id as varchar), '@example.com') as author_email, ts as committed_at,
        case event_type when 'signup' then concat('feat: add item ', cast(event_id as varchar))
          when 'purchase' then concat('fix(core): repair ', cast(event_id as varchar))
          when 'view' then concat('chore: bump ', cast(event_id as varchar))
          when 'click' then concat('update things ', cast(event_id as varchar))
          else 'Merge branch dev' end as subject,
        event_type = 'error' as is_merge from events"""
    t["t_commit_files"] = """with m as (select repo, count(*) as c from t_all_files group by repo)
        select k.repo, k.commit_id, f.path from t_commits k join m on m.repo = k.repo
        join t_all_files f on f.repo = k.repo and (f.n = cast(floor(k.commit_id / 20.0) as bigint) % m.c
          or f.n = (cast(floor(k.commit_id / 20.0) as bigint) * 7 + 3) % m.c)"""
    ends = "(content <> '' and not ends_with(content, chr(10)))"
    t["t_facts"] = f"""select *,
        left(name, cast(length(name) - length(suffix) as bigint)) as stem, lower(suffix) as suffix_lower,
        case when depth > 1 then parts[1] end as top_dir,
        contains(content, '\"\"\"') or contains(content, '''''''') as has_docstring,
        not list_has_any(parts, [{among(R.SCAN_SKIP_DIRS)[1:-1]}]) as scannable
      from (select *, parts[-1] as name, cast(len(parts) as bigint) as depth,
              regexp_extract(parts[-1], '^.+(\\.[^.]+)$', 1) as suffix,
              cast(length(content) - length(replace(content, chr(10), '')) + {ends}::int as bigint) as line_count
            from (select *, string_split(path, '/') as parts from t_files))"""
    t["t_file_facts"] = "select repo, path, name, stem, suffix, suffix_lower, depth, top_dir, size_bytes, line_count from t_facts"
    pruned = f"len(list_filter(parts[1:-2], lambda d: d in {among(R.SKIP_DIRS)} or starts_with(d, '.'))) = 0"
    binary = f"suffix_lower not in {among(R.BINARY_SUFFIXES)}"
    t["t_prune_dirs"] = f"select repo, path from t_facts where {pruned}"
    t["t_rules"] = f"""select repo, ltrim(p, '/') as p from (
        select repo, {strip('s')} as p from (select repo, unnest({lines('content')}) as s from t_files where path = '.gitignore'))
        where p <> '' and not starts_with(p, '#')"""
    t["t_candidates"] = """select repo, path, unnest(list_concat(parts,
        list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/')))) as c from t_facts"""
    t["t_ignored"] = "select distinct c.repo, c.path from t_candidates c join t_rules r on r.repo = c.repo and c.c glob r.p"
    t["t_gitignore_filter"] = "select repo, path from t_facts f where not exists (select 1 from t_ignored i where i.repo = f.repo and i.path = f.path)"
    t["t_binary_ext_filter"] = f"select repo, path from t_facts where {binary}"
    t["t_size_filter"] = "select repo, path, size_bytes from t_facts where size_bytes <= 5000"
    t["t_size_filter_default"] = f"select repo, path, size_bytes from t_facts where size_bytes <= {R.MAX_SIZE_BYTES}"
    t["t_tree"] = f"""select * from t_facts f where {pruned} and {binary}
        and not exists (select 1 from t_ignored i where i.repo = f.repo and i.path = f.path)"""
    t["t_walked_files"] = "select repo, path, size_bytes, line_count from t_tree"
    t["t_scan"] = "select * from t_facts where scannable"
    t["t_scope_all_files"] = "select repo, path from t_scan"
    t["t_corpus_totals"] = "select repo, count(*) as total_files, cast(sum(line_count) as bigint) as total_lines from t_tree group by repo"
    t["t_repos"] = "select distinct repo from t_files"

    # --- languages
    pairs = ", ".join(f"({q(k)}, {q(v)})" for k, v in R.SUFFIX_LANGUAGE.items())
    t["t_suffix_language"] = f"select * from (values {pairs}) v(suffix, language)"
    t["t_language_of"] = """select f.repo, f.path, coalesce(a.language, b.language,
          case when f.name = 'Dockerfile' then 'Dockerfile' end, 'Other') as language
        from t_tree f left join t_suffix_language a on a.suffix = f.suffix_lower
        left join t_suffix_language b on b.suffix = f.suffix"""
    t["t_language_stats"] = """select l.repo, l.language, count(*) as file_count, cast(sum(f.line_count) as bigint) as line_count
        from t_language_of l join t_tree f using (repo, path) group by l.repo, l.language"""
    t["t_language_breakdown"] = """with r as (select repo, sum(file_count) filter (where language <> 'Other') as n from t_language_stats group by repo)
        select s.repo, s.language, s.file_count, s.line_count,
          case when r.n is null then 100.0::double else round(s.file_count::double / r.n * 100, 2) end as percentage
        from t_language_stats s join r on r.repo = s.repo where s.language <> 'Other' or r.n is null"""
    t["t_top_languages"] = """select repo, rank, language, percentage from (select *,
        row_number() over (partition by repo order by percentage desc, language) as rank from t_language_breakdown) where rank <= 10"""

    # --- line patterns
    t["t_py_imports"] = f"""select distinct repo, path, module from (
        select repo, path, split_part(ltrim(a, '.'), '.', 1) as module from (
          select repo, path, unnest(regexp_extract_all(content, {q(R.PY_IMPORT)}, 1)) as a from t_tree where suffix in {among(R.PY_GRAPH_SUFFIXES)})
        union all
        select repo, path, split_part({strip('b')}, '.', 1) from (
          select repo, path, unnest(string_split(g, ',')) as b from (
            select repo, path, unnest(regexp_extract_all(content, {q(R.PY_IMPORT)}, 2)) as g from t_tree where suffix in {among(R.PY_GRAPH_SUFFIXES)})))
        where module <> ''"""
    t["t_js_imports"] = f"""select distinct repo, path, module from (
        select repo, path, unnest(list_concat(regexp_extract_all(content, {q(R.JS_IMPORT)}, 1),
          regexp_extract_all(content, {q(R.JS_IMPORT)}, 2))) as module from t_tree where suffix in {among(R.JS_GRAPH_SUFFIXES)})
        where module <> '' and not starts_with(module, '.')"""
    t["t_code_lines"] = f"""select repo, path, suffix, unnest(ls) as s, cast(generate_subscripts(ls, 1) as bigint) as line
        from (select repo, path, suffix, {lines('content')} as ls from t_tree)"""
    t["t_todo_comments"] = f"""select repo, path, line, upper(regexp_extract(s, {q(R.TODO)}, 1)) as kind,
          {strip(f'regexp_extract(s, {q(R.TODO)}, 2)')} as text
        from t_code_lines where suffix in {among(R.CODE_SUFFIXES)} and regexp_matches(s, {q(R.TODO)})"""
    safe = "not (" + " or ".join(f"regexp_matches(s, {q(p)})" for p in R.SAFE_LINE) + ")"
    t["t_secret_lines"] = f"""select * from (select repo, path, line,
          {case([(f"regexp_matches(s, {q(p)})", q(n)) for n, p in R.LINE_SECRETS])} as rule, {strip('s')} as snippet
        from t_code_lines where {safe}) where rule is not null"""

    # --- architecture
    def marker(x: str) -> str:
        return case(
            [
                (f"regexp_matches({x}, {q(R.PY_FRAMEWORK_LINE.replace('{marker}', m))})", q(m))
                for m in R.PY_FRAMEWORKS
            ]
        )

    t["t_framework_python"] = f"""select repo, path, framework from (select repo, path, {marker('content')} as framework
        from t_tree where name in {among(R.FRAMEWORK_MANIFESTS)}) where framework is not null"""
    valid = "case when name = 'package.json' and json_valid(content) then content end"
    keys = f"list_concat(coalesce(json_keys({valid}, '$.dependencies'), []), coalesce(json_keys({valid}, '$.devDependencies'), []))"
    js = case([(f"list_contains({keys}, {q(dep)})", q(fw)) for fw, dep in R.JS_FRAMEWORKS])
    t["t_framework_js"] = f"""select repo, path, framework from (select repo, path, {js} as framework
        from t_tree where name = 'package.json') where framework is not null"""
    order = [*R.FRAMEWORK_MANIFESTS, "package.json", "manage.py"]
    place = case([(f"name = {q(n)}", str(i)) for i, n in enumerate(order)])
    t["t_framework"] = f"""with last as (select repo, name, path from (select repo, name, path,
            row_number() over (partition by repo, name order by parts desc) as k from t_tree where name in {among(order)}) where k = 1),
        found as (select l.repo, l.name, coalesce(p.framework, j.framework, case when l.name = 'manage.py' then 'django' end) as fw
          from last l left join t_framework_python p using (repo, path) left join t_framework_js j using (repo, path)),
        ranked as (select repo, fw, row_number() over (partition by repo order by {place}) as k from found where fw is not null)
        select r.repo, x.fw as framework from (select distinct repo from t_tree) r left join ranked x on x.repo = r.repo and x.k = 1"""
    t["t_project_type"] = f"""select f.repo, case when bool_or(f.w and f.top_dir in {among(R.MONOREPO_DIRS)}) then 'monorepo'
          when any_value(w.framework) is null and bool_or(f.w and name in ('cli.py', '__main__.py')) then 'cli'
          when any_value(w.framework) is null and bool_or(not f.w and path in ('pyproject.toml', 'setup.py')
            and contains(content, '[project]') and not contains(content, 'scripts')) then 'library'
          else 'monolith' end as project_type
        from (select *, true as w from t_tree union all select f.*, false from t_facts f join t_names n on n.repo = f.repo and n.name = f.path) f
        join t_framework w on w.repo = f.repo group by f.repo"""
    plain = [*R.MVC_DIRS, *R.CLEAN_DIRS, *R.NEUTRAL_DIRS]
    t["t_structure_pattern"] = f"""select repo, case when count(*) filter (where d in {among(R.CLEAN_DIRS)}) > 0 then 'clean'
          when count(*) filter (where d in {among(R.MVC_DIRS)}) >= 2 then 'mvc'
          when count(*) filter (where d not in {among(plain)}) >= 2 then 'feature-based' else 'flat' end as structure_pattern
        from (select distinct repo, lower(top_dir) as d from t_tree) group by repo"""
    t["t_entry_points"] = f"""select repo, path, {case([(f'name = {q(k)}', q(v)) for k, v in R.ENTRY_POINTS.items()])} as entry_type
        from t_tree where name in {among(R.ENTRY_POINTS)}"""
    t["t_layers"] = f"""select repo, lower(top_dir) as layer,
          {case([(f'lower(top_dir) = {q(k)}', q(v)) for k, v in R.LAYERS.items()])} as purpose, path
        from t_tree where lower(top_dir) in {among(R.LAYERS)}"""
    t["t_module_map"] = f"""select repo, module, path as target from (select *, row_number() over (partition by repo, module order by parts desc) as k
        from (select repo, path, parts, stem as module from t_tree where suffix in {among(R.PY_GRAPH_SUFFIXES)}
          union select repo, path, parts, replace(left(path, cast(length(path) - length(suffix) as bigint)), '/', '.') from t_tree where suffix in {among(R.PY_GRAPH_SUFFIXES)}))
        where k = 1"""
    t["t_import_edges"] = """select i.repo, i.path as from_module, m.target as to_module
        from (select * from t_py_imports union all select * from t_js_imports) i join t_module_map m using (repo, module)
        where m.target <> i.path"""
    t["t_module_in_degree"] = "select repo, to_module, count(*) as in_degree from t_import_edges group by repo, to_module"
    t["t_scored_files"] = f"""with scored as (select f.repo, f.path, f.parts, f.name, f.name in {among(R.ENTRY_POINTS)} as entry,
          least(100, case when f.name in {among(R.ENTRY_POINTS)} then 50 else 0 end
            + coalesce(trunc(d.in_degree::double / m.top * 40), 0)
            + case when f.name in {among(R.WELL_KNOWN_FILES)} then 10 else 0 end) as s
          from t_tree f left join t_module_in_degree d on d.repo = f.repo and d.to_module = f.path
          left join (select repo, max(in_degree) as top from t_module_in_degree group by repo) m on m.repo = f.repo)
        select repo, path, parts, case when name = 'README.md' then 'documentation'
          when name in {among(R.PACKAGE_CONFIG_FILES)} then 'package config' when entry then 'entry point' else 'module' end as role,
          cast(s as integer) as importance_score from scored"""
    t["t_key_files"] = f"""select repo, rank, path, role, importance_score from (select *,
          row_number() over (partition by repo order by importance_score desc, parts) as rank from t_scored_files) where rank <= {R.KEY_FILE_LIMIT}"""
    count_of = lambda name, what="count(*)": f"(select {what} from {name} x where x.repo = r.repo)"
    t["t_architecture_report"] = f"""select r.repo, r.total_files, r.total_lines, w.framework, p.project_type, s.structure_pattern,
          {count_of('t_entry_points')} as entry_point_count, {count_of('t_layers', 'count(distinct layer)')} as layer_count,
          {count_of('t_import_edges')} as edge_count, {count_of('t_key_files')} as key_file_count,
          {count_of('t_language_breakdown')} as language_count
        from t_corpus_totals r join t_framework w on w.repo = r.repo join t_project_type p on p.repo = r.repo
        join t_structure_pattern s on s.repo = r.repo"""

    # --- technical debt
    code = f"suffix in {among(R.CODE_SUFFIXES)}"
    tested = "(contains(lower(path), 'test') or contains(lower(path), 'spec'))"
    opened = f"regexp_matches(content, {q('^[' + WS + ']*(' + chr(34) * 3 + '|' + chr(39) * 3 + ')')})"
    t["t_debt_counts"] = f"""select f.repo,
          (select count(*) from t_todo_comments c where c.repo = f.repo) as todo_count,
          cast(coalesce(sum(line_count) filter (where {code}), 0) as bigint) as code_lines,
          count(*) filter (where {code}) as code_files, count(*) filter (where {code} and {tested}) as test_files,
          count(*) filter (where {code} and not {tested}) as source_files,
          count(*) filter (where {code} and line_count > {R.COMPLEX_LINES}) as complex_files,
          count(*) filter (where suffix = '.py') as python_files,
          count(*) filter (where suffix = '.py' and not {opened}) as undocumented_files,
          (select count(*) from t_dead_modules d where d.repo = f.repo) as dead_files
        from t_tree f group by f.repo"""
    density = "(todo_count / (code_lines / 1000.0::double))"
    ratio = "(test_files::double / source_files)"
    gap = "(undocumented_files::double / python_files)"
    dead = "(dead_files::double / python_files)"
    dims = {
        "todo_density": (
            f"case when code_lines = 0 then 0 else least(trunc({density} * 10), 100) end",
            f"case when code_lines = 0 then {q(R.NO_SOURCE)} else printf('%d TODO/FIXME/HACK comments across %d lines (%.1f per 1000 lines)', todo_count, code_lines, {density}) end",
        ),
        "code_staleness": ("0", q(R.STALENESS_DETAIL)),
        "test_coverage": (
            f"case when source_files = 0 then 0 else greatest(0, least(100, trunc((1 - {ratio} * 2) * 100))) end",
            f"case when source_files = 0 then {q(R.NO_SOURCE)} else printf('%d test files vs %d source files (ratio: %.2f)', test_files, source_files, {ratio}) end",
        ),
        "complexity": (
            "case when code_files = 0 then 0 else least(100, trunc(complex_files::double / code_files * 200)) end",
            "case when complex_files > 0 then printf('%d files exceed 500 lines.', complex_files) else 'No files exceed 500 lines.' end",
        ),
        "dependency_freshness": ("0", q(R.FRESHNESS_DETAIL)),
        "documentation": (
            f"case when python_files = 0 then 0 else least(100, trunc({gap} * 100)) end",
            f"case when python_files = 0 then {q(R.NO_PYTHON)} else printf('%d/%d Python files lack module docstrings (%.0f%%)', undocumented_files, python_files, {gap} * 100) end",
        ),
        "dead_code": (
            f"case when python_files = 0 then 0 else greatest(0, least(100, trunc(({dead} - 0.5::double) * 200))) end",
            f"case when python_files = 0 then {q(R.NO_PYTHON)} else printf('%d/%d Python files have no imports from internal modules.', dead_files, python_files) end",
        ),
    }

    def dimension(name: str, *keep: str) -> str:
        score, detail = dims[name]
        return f"select repo, {', '.join(keep)}, cast({score} as integer) as score, {detail} as detail from t_debt_counts"

    t["t_todo_density"] = dimension("todo_density", "todo_count", "code_lines")
    t["t_test_ratio"] = dimension("test_coverage", "test_files", "source_files")
    t["t_complexity"] = dimension("complexity", "complex_files", "code_files")
    t["t_documentation_gap"] = dimension("documentation", "undocumented_files", "python_files")
    t["t_dead_code"] = dimension("dead_code", "dead_files", "python_files")
    t["t_hotspots"] = f"""select repo, rank, path, printf('File has %d lines (threshold: 500)', line_count) as reason,
          cast(least(100, trunc((line_count - 500) / 50.0::double + 50)) as integer) as score
        from (select *, row_number() over (partition by repo order by line_count desc, parts) as rank
          from t_tree where {code} and line_count > {R.COMPLEX_LINES}) where rank <= 10"""
    t["t_dead_modules"] = """with owner as (select repo, stem as module, path from (select *, row_number() over (partition by repo, stem order by parts desc) as k
            from t_tree where suffix = '.py') where k = 1),
        used as (select distinct o.repo, o.path from owner o join t_py_imports i on i.repo = o.repo and i.module = o.module
            where ends_with(i.path, '.py'))
        select f.repo, f.path from t_tree f where suffix = '.py' and stem <> '__init__' and not starts_with(name, 'test_')
          and not exists (select 1 from used u where u.repo = f.repo and u.path = f.path)"""
    t["t_debt_dimensions"] = union(
        f"select repo, {i + 1}::bigint as position, {q(n)} as dimension, cast({dims[n][0]} as integer) as score, {w}::double as weight, {dims[n][1]} as detail from t_debt_counts"
        for i, (n, w) in enumerate(R.DEBT_WEIGHTS.items())
    )
    total = " + ".join(f"({dims[n][0]})::double * {w}::double" for n, w in R.DEBT_WEIGHTS.items())
    t["t_debt_score"] = f"""select repo, score, {ladder('score', R.DEBT_GRADES, 'F', '<=')} as grade from (
        select repo, cast(greatest(0, least(100, trunc({total}))) as integer) as score from t_debt_counts)"""
    advice = case([(f"dimension = {q(n)}", f"{q(a)} || detail || {q(b)}") for n, (a, b) in R.DEBT_ADVICE.items()])
    t["t_debt_recommendations"] = f"""select * from (select repo, rank, dimension, {advice} as recommendation from (
          select *, row_number() over (partition by repo order by score desc, position) as rank from t_debt_dimensions)
        where rank <= 5 and score > 20) where recommendation is not null"""
    title = case([(f"dimension = {q(n)}", q(n.replace("_", " ").title())) for n in R.DEBT_WEIGHTS])
    t["t_debt_chart_rows"] = f"select repo, position, {title} as label, score, {ladder('score', R.DEBT_COLOURS, R.WORST_COLOUR, '<=')} as colour from t_debt_dimensions"
    return {
        **t, **onboarding(), **dependencies(), **conventions(), **surfaces(), **setup_and_history(), **scores(), **reports(),
        **streams(), **extras(), **exports(),
    }


def version_list(x: str) -> str:
    """Release numbers of a version plus ten, without zeros at the end."""
    bare = f"regexp_replace(regexp_extract({x}, '^[vV=\\s]*(\\d+(?:\\.\\d+)*)', 1), '(\\.0+)+$', '')"
    return f"list_transform(string_split({bare}, '.'), lambda n: cast(n as bigint) + 10)"


def extras() -> dict[str, str]:
    t: dict[str, str] = {}
    # --- staleness, as of the newest commit of a repository
    t["t_stale_files"] = """with last as (select f.repo, f.path, max_by(c.commit_id, (c.committed_at, c.commit_id)) as last_commit, max(c.committed_at) as at
            from t_commit_files f join t_commits c using (repo, commit_id) where not c.is_merge group by all),
        heads as (select repo, max(committed_at) as head from t_commits group by repo)
        select f.repo, f.path, l.last_commit, (epoch_us(h.head) - epoch_us(l.at)) // 86400000000 as idle_days,
          case when l.at is null then 'untouched' when epoch_us(h.head) - epoch_us(l.at) >= 14 * 86400000000 then 'stale' else 'fresh' end as status
        from t_tree f left join last l using (repo, path) left join heads h using (repo)"""
    t["t_code_staleness"] = """select *, stale_files::double / nullif(fresh_files + stale_files, 0) as stale_share from (
        select repo, count(*) filter (where status = 'fresh') as fresh_files, count(*) filter (where status = 'stale') as stale_files,
          count(*) filter (where status = 'untouched') as untouched_files from t_stale_files group by repo)"""

    # --- lengths of lines, in buckets that are one wide below 256 and then as wide as the length's lower bits
    fits = case([(f"p99 <= {b}", str(b)) for b in R.LINE_LIMITS])
    quantile = lambda share: f"min(top) filter (where upto >= ceil(whole * {share}::double))"
    t["t_line_length"] = f"""with lengths as (select repo, length(s) as v, greatest(length(bin(length(s))) - 8, 0) as k
            from t_code_lines where suffix in {among(R.CODE_SUFFIXES)}),
        counted as (select repo, (((v >> k) + 1) << k) - 1 as top, count(*) as n from lengths group by all),
        sums as (select repo, top, sum(n) over (partition by repo order by top) as upto, sum(n) over (partition by repo) as whole from counted),
        found as (select repo, cast(max(whole) as bigint) as lines, {quantile(0.5)} as p50, {quantile(0.95)} as p95,
          {quantile(R.LINE_SHARE)} as p99, {quantile(1.0)} as longest from sums group by repo)
        select repo, lines, cast(p50 as bigint) as p50, cast(p95 as bigint) as p95, cast(p99 as bigint) as p99,
          cast(longest as bigint) as longest, cast({fits} as bigint) as line_limit from found"""

    # --- version ranges: one row for each comparison
    def numbered(file: str, value: str) -> str:
        return f"""select repo, unnest(l) as s, generate_subscripts(l, 1) as i from (select repo, {value} as l from t_files where path = {q(file)})"""

    trimmed = f"list_transform({lines('content')}, lambda x: {strip('x')})"
    plain = q(r"^\s*([A-Za-z0-9_.\-]+)\s*(?:\[[^\]]*\])?\s*\(?\s*([^;#@)]*)")
    listed = q("""(?m)^[ \\t]*dependencies\\s*=\\s*\\[((?:[^\\]"'#]|"[^"]*"|'[^']*'|#[^\\n]*)*)\\]""")
    tokens = f"""regexp_extract_all(regexp_extract(coalesce({toml('content', 'project')}, ''), {listed}, 1), {q('"[^"]*"|' + "'[^']*'|#[^" + chr(10) + "]*")}, 0)"""
    required = f"select * from ({numbered('requirements.txt', trimmed)}) where s <> '' and not starts_with(s, '#') and not starts_with(s, '-')"
    project = f"select repo, s[2:-2] as s, i from ({numbered('pyproject.toml', tokens)}) where not starts_with(s, '#')"

    def python(o: int, source: str) -> str:
        return f"""select repo, {o} as o, i, 'pypi' as ecosystem, regexp_extract(s, {plain}, 1) as name, {strip(f'regexp_extract(s, {plain}, 2)')} as spec
            from ({source}) where regexp_matches(s, {plain})"""

    npm = union(
        f"""select repo, {10 + o} as o, generate_subscripts(k, 1) as i, unnest(k) as name, json_extract(content, '$.{section}') as j
          from (select repo, content, json_keys(content, '$.{section}') as k from t_files where path = 'package.json' and json_valid(content))"""
        for o, section in enumerate(["dependencies", "devDependencies", "peerDependencies"])
    )
    entry = q(r"""^["']?([A-Za-z0-9_\-]+)["']?[ \t]*=[ \t]*(?:["']([^"']*)["']|\{.*?\bversion[ \t]*=[ \t]*["']([^"']*)["'])""")
    gem = q(r"""^gem\s+["']([^"']+)["']""")
    bound = q(r"""["']([~<>=!\s]*\d[^"']*)["']""")
    t["t_declared"] = "select *, row_number() over (partition by repo order by o, i) - 1 as position, lower(name) as package from (" + union([
        python(0, required), python(1, project),
        f"""select repo, o, i, 'npm', name, {strip("json_extract_string(j, '$.' || chr(34) || name || chr(34))")} from ({npm})""",
        f"""select repo, 20, i, 'go', regexp_extract(s, {q(R.GO_REQUIRE)}, 1), regexp_extract(s, {q(R.GO_REQUIRE)}, 2) from ({numbered('go.mod', trimmed)})
            where (starts_with(s, 'require') or regexp_matches(s, '^\\S+\\s+v')) and regexp_matches(s, {q(R.GO_REQUIRE)})""",
        f"""select repo, 30, i, 'cargo', regexp_extract(s, {entry}, 1), {strip(f'regexp_extract(s, {entry}, 2) || regexp_extract(s, {entry}, 3)')}
            from t_cargo_lines where section in ('dependencies', 'dev-dependencies') and h is null and regexp_matches(s, {entry})""",
        f"""select repo, 40, i, 'gem', regexp_extract(s, {gem}, 1), array_to_string(regexp_extract_all(regexp_replace(s, {gem}, ''), {bound}, 1), ', ')
            from ({numbered('Gemfile', trimmed)}) where regexp_matches(s, {gem})""",
    ]) + ")"
    op = "regexp_extract(x, '^(===|==|~=|~>|!=|>=|<=|>|<|\\^|~|=)?', 1)"
    bare = case([(f"ecosystem = {q(e)}", q(b)) for e, b in (("pypi", "=="), ("go", "major"), ("cargo", "^"))], "'='")
    t["t_clauses"] = f"""select *, list_concat({version_list('v')}, [4, 0]) as key,
          list_transform(string_split(regexp_extract(v, '^[vV]?(\\d+(?:\\.\\d+)*)', 1), '.'), lambda n: cast(n as bigint)) as parts
        from (select repo, position, ecosystem, package, alt, case when {op} = '' then {bare} else {op} end as op,
            {strip(f"substr(x, length({op}) + 1)")} as v
          from (select *, unnest(string_split_regex(a, case when ecosystem = 'npm' then '\\s+' else '\\s*,\\s*' end)) as x from (
            select *, unnest(alts) as a, generate_subscripts(alts, 1) as alt from (
              select *, case when ecosystem = 'npm' then string_split_regex(spec, '\\s*\\|\\|\\s*') else [spec] end as alts from t_declared))))
        where regexp_matches(v, '^[vV]?\\d')"""
    place = case([
        ("op = '^'", "coalesce(list_position(list_transform(parts, lambda n: n > 0), true), len(parts))"), ("op = 'major'", "1"),
        ("op = '~'", "least(len(parts), 2)"), ("op in ('~=', '~>')", "greatest(len(parts) - 1, 1)"),
    ])
    top = "array_to_string(list_concat(parts[1:p - 1], [parts[p] + 1]), '.')"
    t["t_bounds"] = f"""select * exclude (high), case when op in ('^', 'major', '~', '~=', '~>') then list_concat({version_list(top)}, [0])
            when op in ('=', '==', '===', '<', '<=') then key end as high,
          case when op not in ('<', '<=', '!=') then key end as low,
          op = '>' as low_open, op in ('<', '^', 'major', '~', '~=', '~>') as high_open
        from (select *, {place} as p, null as high from t_clauses)"""
    t["t_known_versions"] = """select ecosystem, package, key as latest_key, regexp_replace(v, '^[vV=\\s]+', '') as latest_version from (
        select *, row_number() over (partition by ecosystem, package order by key desc, regexp_replace(v, '^[vV=\\s]+', '') desc) as k
        from t_clauses where op not in ('<', '!=')) where k = 1"""
    t["t_version_ranges"] = """with ends as (select repo, position, alt, list_sort(list(low))[-1] as low, list_sort(list(high) filter (where high is not null))[1] as high,
            bool_or(low_open) as low_open, bool_or(high_open) as high_open from t_bounds group by all),
        fit as (select repo, position, bool_or(low is null or high is null or low < high or (low = high and not low_open and not high_open)) as ok
          from ends group by all)
        select d.repo, d.position, ecosystem, name, spec, coalesce(ok, true) as satisfiable from t_declared d left join fit using (repo, position)"""
    t["t_latest_version"] = """with each as (select b.repo, b.position, b.alt, bool_and(case when op = '!=' then key <> latest_key else
              (low is null or low < latest_key or (low = latest_key and not low_open))
              and (high is null or latest_key < high or (latest_key = high and not high_open)) end) as ok
            from t_bounds b join t_known_versions k using (ecosystem, package) group by all),
        fit as (select repo, position, bool_or(ok) as ok from each group by all)
        select d.repo, d.position, d.ecosystem, d.name, d.spec, latest_version, case when latest_key is not null then coalesce(f.ok, true) end as admits_latest
        from t_declared d left join fit f using (repo, position) left join t_known_versions k on k.ecosystem = d.ecosystem and k.package = d.package"""

    # --- licenses: expressions here hold no brackets, so alternatives are what stands between OR
    found = union(
        f"select repo, path, line, {q(name)} as license from (" + hits("t_scan", pattern, "1 as one") + ")" for name, pattern in R.LICENSE_NOTICES
    )
    t["t_license_notices"] = found
    heading = q(r"(?im)^#+[ \t]*licen[sc]e[ \t]*\n+[ \t]*([^\n]+?)[ \t.]*$")
    t["t_project_license"] = f"""select r.repo, coalesce(
          (select max(json_extract_string(content, '$.license')) from t_files f where f.repo = r.repo and path = 'package.json' and json_valid(content)),
          (select max(nullif(regexp_extract(content, {heading}, 1), '')) from t_files f where f.repo = r.repo and path = 'README.md')) as license
        from t_repos r"""
    edges = ", ".join(f"({q(a)}, {q(b)})" for a, b in R.LICENSE_ORDER)
    beside = ", ".join(f"({q(a)}, {q(b)})" for a, b in R.LICENSE_BESIDE)
    t["t_order"] = f"select * from (values {edges}) v(inner_license, own)"
    t["t_into"] = f"""with recursive reach(inner_license, own) as (select inner_license, inner_license from t_order union select own, own from t_order
          union select r.inner_license, e.own from reach r join t_order e on e.inner_license = r.own)
        select * from reach union select * from (values {beside}) v(inner_license, own)"""
    packages = ", ".join(f"({q(k)}, {q(v)})" for k, v in R.PACKAGE_LICENSES.items())
    t["t_taken"] = f"""select repo, 'package' as kind, name as source, v.license from t_dependencies d
          left join (values {packages}) v(package, license) on v.package = lower(d.name)
        union all select distinct repo, 'file', path, license from t_license_notices"""
    known = "exists (select 1 from t_into i where i.own = x.own)"
    leaf = f"""case when (kind = 'package' and part in {among(R.LINKABLE)}) or own = part then 1
          when not {known} or not exists (select 1 from t_into i where i.inner_license = part) then null
          when exists (select 1 from t_into i where i.inner_license = part and i.own = x.own) then 1 else 0 end"""
    t["t_license_verdicts"] = f"""with x as (select t.repo, kind, source, t.license, p.license as project_license, p.license as own,
            unnest(string_split(coalesce(t.license, ''), ' OR ')) as part from t_taken t join t_project_license p using (repo)),
        told as (select repo, kind, source, license, project_license, {leaf} as ok from x)
        select repo, kind, source, license, project_license, case when project_license is null or license is null then 'unknown'
          when max(ok) = 1 then 'fits' when bool_or(ok is null) then 'unknown' else 'conflict' end as verdict from told group by repo, kind, source, license, project_license"""
    t["t_license_conflicts"] = "select * exclude (verdict) from t_license_verdicts where verdict = 'conflict'"
    return t


def exports() -> dict[str, str]:
    """Public symbols and their uses; the files here have no stars, no __all__ and no lists of exports."""
    t: dict[str, str] = {}
    py = r"(?m)^(?:async[ \t]+)?(?:def|class)[ \t]+[A-Za-z_]\w*|^[A-Z][A-Z0-9_]*[ \t]*(?::[^=\n]+)?=(?:[^=]|$)"
    js = (
        r"(?m)^[ \t]*export[ \t]+(?:default[ \t]+)?(?:abstract[ \t]+)?(?:async[ \t]+)?"
        r"(?:function\*?|class|const|let|var|interface|type|enum)[ \t]+[A-Za-z_$][\w$]*|^[ \t]*export[ \t]+default\b"
    )
    t["t_py_files"] = "select * from t_tree where suffix = '.py'"
    t["t_js_files"] = f"select * from t_tree where suffix in {among(R.JS_SUFFIXES)}"
    named = r"(?:function\*?|class|const|let|var|interface|type|enum)[ \t]+([\w$]+)$"
    word = r"(function|class|const|let|var|interface|type|enum)\*?[ \t]+[\w$]+$"
    t["t_symbols"] = f"""select repo, path, line, coalesce(nullif(regexp_extract(m, '(?:def|class)[ \\t]+(\\w+)', 1), ''), regexp_extract(m, '^(\\w+)', 1)) as name,
          case when regexp_matches(m, '^(?:async[ \\t]+)?def\\b') then 'function' when regexp_matches(m, '^class\\b') then 'class' else 'constant' end as kind
        from ({hits('t_py_files', py, '1 as one')})
        union all select repo, path, line, case when regexp_matches(m, 'export[ \\t]+default\\b') then 'default' else regexp_extract(m, {q(named)}, 1) end,
          case regexp_extract(m, {q(word)}, 1) when 'const' then 'constant' when 'let' then 'constant' when 'var' then 'constant' when '' then 'default'
            else regexp_extract(m, {q(word)}, 1) end
        from ({hits('t_js_files', js, '1 as one')})"""
    t["t_public"] = """select repo, path, name, arg_min(kind, (line, kind)) as kind, min(line) as line from t_symbols where not starts_with(name, '_') group by all"""
    taken = r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(?:\(([^)]*)\)|([^\n#;]+))"
    whole = r"(?m)^[ \t]*import[ \t]+([^\n#;]+)"
    member = r"(?:^|[^\w$.])([A-Za-z_$][\w$]*)\.([A-Za-z_$][\w$]*)"
    item = lambda x: f"{strip(x)} as x"
    halves = "regexp_extract(x, '^(\\S+)', 1) as name, regexp_extract(x, '(\\S+)$', 1) as alias"
    t["t_taken_names"] = f"""select repo, path, module, {halves} from (select repo, path, module, {item('unnest(string_split(names, chr(44)))')} from (
          select repo, path, unnest(regexp_extract_all(content, {q(taken)}, 1)) as module,
            unnest(list_transform(list_zip(regexp_extract_all(content, {q(taken)}, 2), regexp_extract_all(content, {q(taken)}, 3)), lambda z: concat(z[1], z[2]))) as names
          from t_py_files)) where x <> ''"""
    t["t_wholes"] = f"""select repo, path, {halves.replace(' as name', ' as module')} from (select repo, path, {item('unnest(string_split(names, chr(44)))')} from (
          select repo, path, unnest(regexp_extract_all(content, {q(whole)}, 1)) as names from t_py_files)) where x <> ''
        union all select repo, path, module || name, alias from t_taken_names where regexp_matches(module, '^\\.+$')"""
    t["t_members"] = f"""select distinct repo, path, owner, name from (select repo, path, unnest(regexp_extract_all(content, {q(member)}, 1)) as owner,
          unnest(regexp_extract_all(content, {q(member)}, 2)) as name from t_py_files)"""
    t["t_links"] = """select repo, path, module, name, alias, true as exported from t_taken_names
        union all select w.repo, w.path, w.module, m.name, m.name, false from t_wholes w join t_members m on m.repo = w.repo and m.path = w.path and m.owner = w.alias"""
    t["t_places"] = """with m as (select distinct l.repo, l.path, l.module, f.parts, length(regexp_extract(l.module, '^(\\.+)', 1)) as dots,
            replace(regexp_replace(l.module, '^\\.+', ''), '.', '/') as plain from t_links l join t_tree f using (repo, path)),
        beside as (select *, array_to_string(list_concat(parts[1:len(parts) - greatest(dots, 1)], case when plain = '' then [] else [plain] end), '/') as base from m),
        bases as (select repo, path, module, base, 0 as o from beside union all select repo, path, module, plain, 3 from beside where dots = 0),
        paths as (select repo, path, module, base || unnest(['.py', '.pyi', '/__init__.py']) as target, o + unnest([0, 1, 2]) as place from bases
          union all select l.repo, l.path, l.module, x.target, 1000 from m l join t_module_map x on x.repo = l.repo and x.module = l.module and l.dots = 0)
        select repo, path, module, arg_min(target, place) as target from paths p
        where exists (select 1 from t_tree f where f.repo = p.repo and f.path = p.target) group by all"""
    t["t_led"] = "select l.repo, l.path, l.name, l.alias, l.exported, p.target from t_links l join t_places p using (repo, path, module) where p.target <> l.path"
    t["t_moving"] = """select distinct repo, target as start, name as asked, target as at_path, name as symbol from t_led
        union select m.repo, m.start, m.asked, l.target, l.name from t_moving m
          join t_led l on l.repo = m.repo and l.path = m.at_path and l.alias = m.symbol and l.exported
          left join t_public d on d.repo = m.repo and d.path = m.at_path and d.name = m.symbol where d.name is null"""
    t["t_public_exports"] = """with used as (select distinct l.repo, l.path as user_path, m.at_path as path, m.symbol as name
            from t_led l join t_moving m on m.repo = l.repo and m.start = l.target and m.asked = l.name where l.path <> m.at_path)
        select d.repo, d.path, d.name, d.kind, d.line, count(u.user_path) as uses, count(u.user_path) > 0 as used
        from t_public d left join used u using (repo, path, name) group by d.repo, d.path, d.name, d.kind, d.line"""
    return t


def streams() -> dict[str, str]:
    """What a stream gives in the end is what the batch gives; file n of a repository arrives n hours after 2024 begins."""
    walked = "exists (select 1 from t_tree x where x.repo = s.repo and x.path = s.{})"
    t = {
        "t_stream_todo_comments": "select * from t_todo_comments",
        "t_stream_secret_findings": f"select * from t_secret_findings s where {walked.format('file')}",
        "t_stream_endpoints": f"select * from t_endpoints s where {walked.format('handler_file')}",
    }

    def counted(name: str, file: str) -> str:
        return f"(select repo, {file} as path, count(*) as c from t_{name} group by all)"

    sums = {"files": "1", "lines": "f.line_count", "todos": "coalesce(a.c, 0)", "secrets": "coalesce(b.c, 0)", "routes": "coalesce(c.c, 0)"}
    t["t_stream_days"] = f"""select f.repo, cast(19723 + floor(f.n / 24) as bigint) as day,
          {', '.join(f'cast(sum({x}) as bigint) as {name}' for name, x in sums.items())}
        from t_tree f left join {counted('todo_comments', 'path')} a using (repo, path)
        left join {counted('stream_secret_findings', 'file')} b using (repo, path)
        left join {counted('stream_endpoints', 'handler_file')} c using (repo, path) group by all"""
    t["t_stream_daily_totals"] = f"""select *, {', '.join(f'cast(sum({n}) over w as bigint) as {n}_so_far' for n in sums)}
        from t_stream_days window w as (partition by repo order by day)"""
    return t


def onboarding() -> dict[str, str]:
    t: dict[str, str] = {}
    rank = case([(f"path = {q(n)}", str(i)) for i, n in enumerate(R.README_NAMES)])
    t["t_readme"] = f"""select repo, path as readme, content from (select *, row_number() over (partition by repo order by {rank}) as k
        from t_files where path in {among(R.README_NAMES)}) where k = 1"""
    t["t_readme_pick"] = "select repo, readme from t_readme"
    t["t_readme_lines"] = f"""select repo, content, unnest(ls) as s, generate_subscripts(ls, 1) as i from (
        select repo, content, list_transform({lines('content')}, lambda x: {strip('x')}) as ls from t_readme)"""
    quoted = f"case when starts_with(s, '>') then {strip('s[2:]')} else s end"
    plain = f"regexp_replace(regexp_replace({quoted}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\*{{1,2}}([^*]+)\\*{{1,2}}', '\\1', 'g')"
    t["t_readme_summary"] = f"""with marked as (select *, sum((s = '' or starts_with(s, '#'))::int) over (partition by repo order by i) as para from t_readme_lines),
        kept as (select repo, para, i, {plain} as x from marked where s <> '' and not starts_with(s, '#')
          and not starts_with(s, '```') and not starts_with(s, '![') and not starts_with(s, '|')
          and not regexp_matches(s, '^\\[!?\\[') and not regexp_matches(s, '^\\[.*\\]\\(.*\\)\\s*$')),
        paras as (select repo, para, string_agg(x, ' ' order by i) as p from kept where x <> '' group by repo, para),
        first as (select repo, p from (select *, row_number() over (partition by repo order by para) as k from paras
          where length(p) > 20 and not starts_with(p, '```')) where k = 1)
        select r.repo, case when d.repo is null then {q(R.NO_README)} when d.content = '' then {q(R.EMPTY_README)}
          else coalesce(f.p, {strip('d.content')}) end as project_summary
        from t_repos r left join t_readme d on d.repo = r.repo left join first f on f.repo = r.repo"""

    def steps(source: str) -> str:
        return f"""with ls as (select repo, path as readme, unnest(l) as line, generate_subscripts(l, 1) as i
            from (select repo, path, {lines('content')} as l from {source} where path in ('README.md', 'README.rst'))),
        kinds as (select *, {strip('line')} as s, regexp_matches(line, {q(R.SETUP_HEADING)}) as kw,
            starts_with({strip('line')}, '```') as fence from ls),
        started as (select k.* from kinds k join (select repo, readme, min(i) as b from kinds where kw group by repo, readme) x
            on x.repo = k.repo and x.readme = k.readme and k.i >= x.b),
        state as (select *, coalesce(sum(fence::int) over (partition by repo, readme order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as inside from started),
        stops as (select repo, readme, min(i) as e from state where not inside and not fence and not kw and regexp_matches(line, '^#+\\s+') group by repo, readme)
        select s.repo, s.readme, row_number() over (partition by s.repo, s.readme order by s.i) as position, s.s as command
        from state s left join stops x on x.repo = s.repo and x.readme = s.readme
        where s.inside and not s.fence and s.s <> '' and (x.e is null or s.i < x.e)"""

    t["t_readme_setup_steps"] = steps("t_files")
    t["t_names"] = "select distinct repo, name from t_tree"
    # root files count when the walk met their name anywhere
    t["t_met"] = "select f.* from t_files f join t_names n on n.repo = f.repo and n.name = f.path"
    t["t_tree_readme_steps"] = steps("t_met")
    fallback = union(
        f"select repo, {i} as o, {q(text)} as description, {q(cmd)} as command from t_names where name = {q(n)}"
        for i, (n, text, cmd) in enumerate(R.FALLBACK_SETUP)
    )
    t["t_setup_steps"] = f"""with best as (select repo, min(readme) as readme from t_tree_readme_steps group by repo)
        select s.repo, s.position, 'Run: ' || s.command as description, s.command from t_tree_readme_steps s join best b on b.repo = s.repo and b.readme = s.readme
        union all select repo, row_number() over (partition by repo order by o), description, command from ({fallback})
        where repo not in (select repo from best)"""
    script = lambda name: f"json_extract_string(content, '$.scripts.\"{name}\"') is not null"
    tail = "regexp_extract(content, '(?is)##\\s*test.*', 0)"
    rest = f"substr({tail}, strpos({tail}, chr(10)) + 1)"
    section = f"substr({tail}, 1, strpos({tail}, chr(10))) || split_part({rest}, chr(10) || '##', 1)"
    t["t_test_lines"] = f"""select repo, bi, generate_subscripts(l, 1) as li, {strip('unnest(l)')} as c from (
        select repo, bi, {lines(strip('b'))} as l from (select repo, unnest(bs) as b, generate_subscripts(bs, 1) as bi from (
          select repo, regexp_extract_all({section}, '(?s)```[a-z]*\\n(.*?)```', 1) as bs from t_met
          where path = 'README.md' and strpos({tail}, chr(10)) > 0)))"""
    t["t_test_commands"] = f"""with found as (
          select repo, 1 as o, 0 as a, 0 as b, 'npm test' as c from t_met where path = 'package.json' and json_valid(content) and {script('test')}
          union all select repo, 2, 0, 0, 'npm run test:unit' from t_met where path = 'package.json' and json_valid(content) and {script('test:unit')}
          union all select distinct repo, 3, 0, 0, 'pytest' from t_names where name in ('pytest.ini', 'pyproject.toml', 'setup.cfg')
          union all select repo, 4, bi, li, c from t_test_lines where c <> '' and not starts_with(c, '#')
          union all select repo, 5, generate_subscripts(m, 1), 0, 'make ' || unnest(m) from (
            select repo, regexp_extract_all(content, {q(R.MAKE_TEST_TARGET)}, 1) as m from t_met where path = 'Makefile')),
        firsts as (select * from (select *, row_number() over (partition by repo, c order by o, a, b) as k from found) where k = 1)
        select repo, row_number() over (partition by repo order by o, a, b) as position, c as command from firsts"""
    has = lambda *n: f"bool_or(name in {among(n)})"
    env = f"bool_or(regexp_matches(path, {q(R.ENV_REFERENCE)}) or (suffix in {among(R.GLOSSARY_SUFFIXES)} and regexp_matches(content, {q(R.ENV_REFERENCE)})))"
    rules = [
        f"not {has('.env', '.env.example')} and {env}",
        "not bool_or(contains(lower(path), 'test'))",
        f"{has('requirements.txt')} and not {has('Makefile')}",
        f"{has('package.json')} and not {has('.nvmrc', '.node-version')}",
    ]
    found = union(
        f"select repo, {i} as o, {q(g)} as gotcha from t_tree group by repo having {c}" for i, (g, c) in enumerate(zip(R.GOTCHAS, rules))
    )
    t["t_gotchas"] = f"select repo, row_number() over (partition by repo order by o) as position, gotcha from ({found})"
    term = q(R.GLOSSARY_TERM)
    t["t_terms"] = f"""select *, row_number() over (partition by repo order by parts, i) as o from (
        select repo, parts, generate_subscripts(a, 1) as i, unnest(a) as term, unnest(b) as meaning from (
          select repo, parts, regexp_extract_all(content, {term}, 1) as a, regexp_extract_all(content, {term}, 2) as b
          from t_tree where suffix in {among(R.GLOSSARY_SUFFIXES)}))
        where term not in {among(R.GLOSSARY_IGNORED)} and length(term) <= 30"""
    t["t_glossary"] = "select repo, term, max_by(meaning, o) as meaning from t_terms group by repo, term"
    t["t_first_terms"] = """with firsts as (select repo, term, min(o) as f from t_terms group by repo, term),
        ranked as (select *, row_number() over (partition by repo order by f) as position from firsts),
        ends as (select repo, f as e from ranked where position = 10)
        select r.repo, r.position, r.term, max_by(x.meaning, x.o) as meaning from ranked r join t_terms x on x.repo = r.repo and x.term = r.term
        left join ends e on e.repo = r.repo where r.position <= 10 and (e.e is null or x.o <= e.e) group by r.repo, r.position, r.term"""
    t["t_architecture_overview"] = """with langs as (select repo, string_agg(printf('%s (%.0f%%)', language, percentage), ', ' order by rank) as x from t_top_languages where rank <= 3 group by repo),
        eps as (select repo, string_agg(path || ' (' || entry_type || ')', ', ' order by k) as x from (
          select *, row_number() over (partition by repo order by string_split(path, '/')) as k from t_entry_points) where k <= 3 group by repo),
        lays as (select repo, string_agg(layer, ', ' order by k) as x from (select *, row_number() over (partition by repo order by f) as k from (
          select repo, layer, min(string_split(path, '/')) as f from t_layers group by repo, layer)) where k <= 5 group by repo)
        select r.repo, 'This is a ' || p.project_type || ' project' || case when r.framework is null then '' else ' using ' || r.framework end
            || ' with a ' || s.structure_pattern || ' structure.' || coalesce(' Primary languages: ' || l.x || '.', '')
            || coalesce(' Entry points: ' || e.x || '.', '') || coalesce(' Layers detected: ' || y.x || '.', '') as architecture_overview
        from t_framework r join t_project_type p on p.repo = r.repo join t_structure_pattern s on s.repo = r.repo
        left join langs l on l.repo = r.repo left join eps e on e.repo = r.repo left join lays y on y.repo = r.repo"""
    t["t_top_contributors"] = """select * from (select repo, row_number() over (partition by repo order by commits desc, newest_at desc, newest_commit desc) as rank,
        name, email, commits as recent_commits from t_authors) where rank <= 10"""
    t["t_onboarding_key_files"] = "select * from t_key_files where rank <= 10"
    return t


def dependencies() -> dict[str, str]:
    t: dict[str, str] = {}

    def numbered(file: str, value: str) -> str:
        return f"""select repo, unnest(l) as s, generate_subscripts(l, 1) as i from (select repo, {value} as l from t_files where path = {q(file)})"""

    trimmed = f"list_transform({lines('content')}, lambda x: {strip('x')})"
    name, version = spec_columns("s")

    def python_deps(source: str) -> str:
        return f"""select repo, row_number() over (partition by repo order by i) - 1 as position, name, {unknown('version')} as current_version,
            cast(null as varchar) as license, {status('name', 'version')} as status
          from (select repo, i, {name} as name, {version} as version from ({source})) where name <> ''"""

    t["t_deps_requirements"] = python_deps(
        f"select * from ({numbered('requirements.txt', trimmed)}) where s <> '' and not starts_with(s, '#') and not starts_with(s, '-')"
    )
    listed = """(?m)^[ \\t]*dependencies\\s*=\\s*\\[((?:[^\\]"'#]|"[^"]*"|'[^']*'|#[^\\n]*)*)\\]"""
    body = toml("content", "project")
    tokens = f"""regexp_extract_all(regexp_extract(coalesce({body}, ''), {q(listed)}, 1), {q('"[^"]*"|' + "'[^']*'|#[^" + chr(10) + "]*")}, 0)"""
    t["t_deps_pyproject"] = python_deps(
        f"select repo, s[2:-2] as s, i from ({numbered('pyproject.toml', tokens)}) where not starts_with(s, '#')"
    )
    parts = []
    for o, section in enumerate(["dependencies", "devDependencies", "peerDependencies"]):
        parts.append(
            f"""select repo, {o} as o, generate_subscripts(k, 1) as i, unnest(k) as name, json_extract(content, '$.{section}') as j,
              json_extract_string(content, '$.license') as license
            from (select repo, content, json_keys(content, '$.{section}') as k from t_files where path = 'package.json' and json_valid(content))"""
        )
    spec = strip("ltrim(json_extract_string(j, '$.\"' || name || '\"'), '^~>=<')")
    t["t_deps_package_json"] = f"""select repo, row_number() over (partition by repo order by o, i) - 1 as position, name, {unknown('v')} as current_version,
          license, case when v = '' then 'unknown' else 'ok' end as status
        from (select repo, o, i, name, license, {spec} as v from ({union(parts)}))"""

    def plain(source: str, name: str, version: str) -> str:
        return f"""select repo, row_number() over (partition by repo order by i) - 1 as position, name, {unknown('v')} as current_version,
            cast(null as varchar) as license, 'ok' as status from (select repo, i, {name} as name, {version} as v from ({source}))"""

    t["t_deps_go_mod"] = plain(
        f"""select * from ({numbered('go.mod', trimmed)}) where (starts_with(s, 'require') or regexp_matches(s, '^\\S+\\s+v')) and regexp_matches(s, {q(R.GO_REQUIRE)})""",
        f"regexp_extract(s, {q(R.GO_REQUIRE)}, 1)", f"ltrim(regexp_extract(s, {q(R.GO_REQUIRE)}, 2), 'v')",
    )
    # section carried forward over the lines
    t["t_cargo_lines"] = f"""select *, last_value(h ignore nulls) over (partition by repo order by i rows between unbounded preceding and current row) as section
        from (select repo, s, i, case when regexp_matches(s, '^\\[') then {strip("trim(s, '[]')")} end as h from ({numbered('Cargo.toml', trimmed)}))"""
    entry = r"""^["']?([A-Za-z0-9_\-]+)["']?[ \t]*=[ \t]*(.+)$"""
    value = f"regexp_extract(s, {q(entry)}, 2)"
    quoted = q("""^["']([^"']*)["']""")
    inner = q("""(?:^|[{,])[ \t]*version[ \t]*=[ \t]*["']([^"']*)["']""")
    found = f"case when regexp_matches({value}, {quoted}) then regexp_extract({value}, {quoted}, 1) else regexp_extract({value}, {inner}, 1) end"
    t["t_deps_cargo"] = f"""select repo, row_number() over (partition by repo order by o, i) - 1 as position, name, {unknown('v')} as current_version,
          cast(null as varchar) as license, 'ok' as status from (
          select repo, i, case section when 'dependencies' then 0 else 1 end as o, regexp_extract(s, {q(entry)}, 1) as name,
            {strip(f"ltrim({found}, '^~>=<')")} as v
          from t_cargo_lines where section in ('dependencies', 'dev-dependencies') and h is null and regexp_matches(s, {q(entry)}))"""
    t["t_deps_gemfile"] = plain(
        f"select * from ({numbered('Gemfile', trimmed)}) where starts_with(s, 'gem ') and regexp_matches(s, {q(R.GEM_LINE)})",
        f"regexp_extract(s, {q(R.GEM_LINE)}, 1)", strip(f"ltrim(regexp_extract(s, {q(R.GEM_LINE)}, 2), '~>=<')"),
    )
    manifests = ["requirements", "pyproject", "package_json", "go_mod", "cargo", "gemfile"]
    t["t_dep_status"] = """select repo, row_number() over (partition by repo order by o, position) - 1 as position, name, current_version, status from (
        select 0 as o, * from t_deps_requirements union all select 1, * from t_deps_pyproject)"""
    t["t_all_deps"] = "select repo, row_number() over (partition by repo order by o, position) - 1 as position, name, current_version, license, status from (" + union(
        f"select {i} as o, * from t_deps_{m}" for i, m in enumerate(manifests)
    ) + ")"
    t["t_dependencies"] = """select repo, position, name, current_version, license, status from (
        select *, row_number() over (partition by repo, lower(name) order by position) as k from t_all_deps) where k = 1"""
    has = lambda p: f"exists (select 1 from t_files f where f.repo = r.repo and f.path = {q(p)})"
    some = lambda n: f"exists (select 1 from {n} d where d.repo = r.repo)"
    t["t_package_manager"] = f"""select repo, case
          when {has('package.json')} and ((not {has('requirements.txt')} and not {has('pyproject.toml')}) or {some('t_deps_package_json')}) then 'npm'
          when {has('requirements.txt')} or {some('t_deps_pyproject')} then 'pip' when {has('go.mod')} then 'go'
          when {has('Cargo.toml')} then 'cargo' when {has('Gemfile')} then 'bundler' else 'none' end as package_manager from t_repos r"""
    t["t_dependency_risk"] = """select repo, n as total_deps, n as direct_deps, o as outdated_count, 0::bigint as vulnerability_count,
          cast(case when n = 0 then 0 else least(100, trunc(o::double / n * 40) + case when n > 100 then 20 when n > 50 then 10 else 0 end) end as integer) as risk_score
        from (select r.repo, count(d.name) as n, count(*) filter (where d.status = 'outdated') as o from t_repos r left join t_dependencies d on d.repo = r.repo group by r.repo)"""
    return t


def conventions() -> dict[str, str]:
    t: dict[str, str] = {}
    js = f"suffix in {among(R.JS_SUFFIXES)}"
    t["t_sample"] = f"""select * from (select *, row_number() over (partition by repo order by parts) as rank,
          {lines('content')} as ls from t_scan where suffix in {among(R.CONVENTION_SUFFIXES)}
          and not contains(lower(name), 'test') and not contains(lower(name), 'spec')
          and coalesce(lower(parts[-2]), '') not in ('tests', '__tests__'))"""
    t["t_convention_sample"] = f"select repo, rank, path from t_sample where rank <= {R.CONVENTION_SAMPLE}"
    n = lambda p: f"len(regexp_extract_all(content, {q(p)}))"
    t["t_naming_style"] = f"""with v as (select repo, sum({n(R.SNAKE_FUNCTION)}) as snake, sum({n(R.CAMEL_FUNCTION)} + {n(R.CAMEL_VARIABLE)}) as camel,
          sum({n(R.PASCAL_CLASS)}) as pascal, bool_or(suffix = '.py') as py, bool_or({js}) as js,
          count(*) filter (where contains(stem, '_') and stem = lower(stem)) as sf, count(*) filter (where contains(stem, '-')) as kf from t_sample group by repo)
        select r.repo, case when py and js then 'mixed' when py then 'snake_case' when js then 'camelCase' end as variables,
          case when snake > 0 or camel > 0 then case when snake >= camel then 'snake_case' else 'camelCase' end end as functions,
          case when pascal > 0 then 'PascalCase' end as classes,
          case when sf > kf then 'snake_case' when kf > sf then 'kebab-case' end as files
        from t_repos r left join v on v.repo = r.repo"""
    t["t_indent_per_file"] = """select repo, path, a as tab_lines, b as two_space_lines, c as four_space_lines,
          case when a > c and a > b then 'tabs' when c > b then '4' when b > 0 then '2' end as indent from (select repo, path, rank,
            len(list_filter(ls, lambda x: starts_with(x, chr(9)))) as a,
            len(list_filter(ls, lambda x: starts_with(x, '  ') and not starts_with(x, '   '))) as b,
            len(list_filter(ls, lambda x: starts_with(x, '    '))) as c from t_sample)"""
    t["t_indent_votes"] = """select repo, indent, count(*) as v, sum(count(*)) over (partition by repo) as total,
          row_number() over (partition by repo order by count(*) desc, min(rank)) as k
        from t_indent_per_file join t_sample using (repo, path) where indent is not null group by repo, indent"""
    t["t_indent_style"] = """select r.repo, case when indent = 'tabs' then 'tabs' when indent is not null then 'spaces' end as indent_style,
          case when indent <> 'tabs' then cast(indent as integer) end as indent_width
        from t_repos r left join t_indent_votes v on v.repo = r.repo and v.k = 1"""
    t["t_quote_style"] = f"""with f as (select repo, rank, length(content) - length(replace(content, '''', '')) as a, length(content) - length(replace(content, '"', '')) as b
            from t_sample where {js}),
        v as (select repo, case when a > b then 'single' else 'double' end as vote, count(*) as c, min(rank) as s from f where a <> b group by 1, 2),
        w as (select *, row_number() over (partition by repo order by c desc, s) as k from v)
        select r.repo, w.vote as quotes from t_repos r left join w on w.repo = r.repo and w.k = 1"""
    counted = f"list_filter(ls, lambda x: {strip('x')} <> '' and not starts_with({strip('x')}, '//'))"
    t["t_semicolon_style"] = f"""with f as (select repo, len(list_filter({counted}, lambda x: ends_with(rtrim(x, {q(WS)}), ';'))) as a, len({counted}) as b from t_sample where {js}),
        v as (select repo, count(*) filter (where a > b - a) as y, count(*) filter (where not a > b - a) as z from f group by repo)
        select r.repo, v.y >= v.z as semicolons from t_repos r left join v on v.repo = r.repo"""
    py = "suffix = '.py'"
    t["t_import_style"] = f"""with v as (select repo,
            sum(case when {py} then {n(R.PY_RELATIVE_IMPORT)} when {js} then {n(R.JS_RELATIVE_IMPORT)} else 0 end) as a,
            sum(case when {py} then {n(R.PY_ABSOLUTE_IMPORT)} when {js} then {n(R.JS_ABSOLUTE_IMPORT)} else 0 end) as b from t_sample group by repo),
        w as (select r.repo, cast(coalesce(a, 0) as bigint) as a, cast(coalesce(b, 0) as bigint) as b from t_repos r left join v on v.repo = r.repo)
        select repo, a as relative_imports, b as absolute_imports, case when a + b = 0 then 'unknown' when a > 0 and b > 0 then
            case when a::double / (a + b) > 0.7 then 'relative' when a::double / (a + b) < 0.3 then 'absolute' else 'mixed' end
          when a > 0 then 'relative' else 'absolute' end as import_style from w"""
    t["t_error_handling"] = f"""with v as (select r.repo, cast(coalesce(sum({n(R.TRY_EXCEPT)} + {n(R.TRY_CATCH)}), 0) as bigint) as tries,
            cast(coalesce(sum({n(R.RESULT_TYPE)}), 0) as bigint) as results, cast(coalesce(sum({n(R.ERROR_FIRST)}), 0) as bigint) as error_first
          from t_repos r left join t_sample s on s.repo = r.repo group by r.repo)
        select *, case when tries >= results and tries >= error_first then 'try-catch' when results >= error_first then 'result-type' else 'error-first' end as error_handling from v"""
    t["t_test_pattern"] = """with v as (select repo, bool_or(parts[1] in ('tests', 'test') and depth > 1) as a, bool_or(list_contains(parts, '__tests__')) as b,
            bool_or(ends_with(path, '.test.js') or ends_with(path, '.spec.js')) as c from t_facts group by repo)
        select repo, case when a and not b and not c then 'separate-dir' when c and not a then 'co-located' when b and not a then 'co-located'
          when a or b or c then 'mixed' else 'unknown' end as test_pattern from v"""
    t["t_commit_format"] = f"""with l as (select *, row_number() over (partition by repo order by committed_at desc, commit_id desc) as k from t_commits)
        select repo, c as conventional, s as subjects, case when c::double / s > 0.5 then 'conventional-commits' else 'freeform' end as commit_format from (
          select repo, count(*) filter (where regexp_matches(subject, {q(R.CONVENTIONAL_SUBJECT)})) as c, count(*) as s from l group by repo)"""
    place = case([(f"path = {q(p)}", str(i)) for i, p in enumerate(R.LINTER_FILES)])
    t["t_linter_config"] = f"""select r.repo, l.path as linter_config from t_repos r left join (
        select repo, path, row_number() over (partition by repo order by {place}) as k from t_files where path in {among(R.LINTER_FILES)}) l on l.repo = r.repo and l.k = 1"""
    t["t_consistency_score"] = """select r.repo, cast(case when v.repo is null then 100 else greatest(0, trunc(100 - (1.0::double - v.v::double / v.total) * 100)) end as integer) as consistency_score
        from t_repos r left join t_indent_votes v on v.repo = r.repo and v.k = 1"""
    t["t_convention_report"] = """select n.*, i.indent_style, i.indent_width, q.quotes, s.semicolons, m.import_style, e.error_handling, p.test_pattern, c.commit_format, l.linter_config, y.consistency_score
        from t_naming_style n join t_indent_style i using (repo) join t_quote_style q using (repo) join t_semicolon_style s using (repo) join t_import_style m using (repo)
        join t_error_handling e using (repo) join t_test_pattern p using (repo) left join t_commit_format c using (repo) join t_linter_config l using (repo) join t_consistency_score y using (repo)"""
    return t


def surfaces() -> dict[str, str]:
    t: dict[str, str] = {}
    js = f"suffix in {among(R.JS_SUFFIXES)}"
    out = "repo, path as handler_file, method, route"
    t["t_routes_flask"] = f"""select {out} from (
        select repo, path, route, upper(trim({strip('unnest(string_split(methods, chr(44)))')}, '"''')) as method
        from (select repo, path, route, case when coalesce(m, '') = '' then 'GET' else m end as methods
            from ({groups('t_scan', R.FLASK_ROUTE, ['route', 'm'], "suffix = '.py'")}))) where method <> ''"""
    t["t_routes_fastapi"] = f"select repo, path as handler_file, upper(m) as method, route from ({groups('t_scan', R.FASTAPI_ROUTE, ['m', 'route'], chr(115) + chr(117) + 'ffix = ' + q('.py'))})"
    urls = "name = 'urls.py'"
    t["t_routes_django"] = f"""select repo, path as handler_file, 'GET' as method, '/' || ltrim(p, '/') as route from ({groups('t_scan', R.DJANGO_PATH, ['p'], urls)})
        union all select repo, path, 'GET', '/' || rtrim(ltrim(ltrim(p, '/'), '^'), '$') from ({groups('t_scan', R.DJANGO_RE_PATH, ['p'], urls)})"""
    t["t_routes_express"] = f"""select repo, path as handler_file, upper(m) as method, p as route from (
        {groups('t_scan', R.EXPRESS_ROUTE, ['m', 'p'], f"{js} and not (list_contains(parts, 'pages') and list_contains(parts, 'api'))")})"""
    route = "'/api/' || regexp_replace(regexp_replace(regexp_replace(substr(path, 11), '\\.[jt]sx?$', ''), '(^|/)index$', ''), '\\[([^\\]]+)\\]', '{\\1}', 'g')"
    t["t_next_methods"] = f"""select repo, path, {route} as route, regexp_extract_all(content, {q(R.NEXT_METHOD)}, 1) as a,
          regexp_extract_all(regexp_extract(content, {q(R.NEXT_ALLOW)}, 1), '[''"]([A-Z]+)[''"]', 1) as b
        from t_scan where starts_with(path, 'pages/api/') and {js}"""
    t["t_routes_next_pages"] = """select repo, path as handler_file, unnest(a) as method, route from t_next_methods
        union all select distinct repo, path, m, route from (select repo, path, route, a, unnest(b) as m from t_next_methods) where not list_contains(a, m)
        union all select repo, path, 'GET', route from t_next_methods where len(a) = 0 and len(b) = 0"""
    t["t_routes_next_app"] = """select repo, path as handler_file, 'GET' as method, '/api/' || array_to_string(parts[3:-2], '/') as route
        from t_facts where starts_with(path, 'app/api/') and starts_with(name, 'route.') and suffix in ('.js', '.ts')"""
    t["t_cli_click"] = f"""select repo, path as handler_file, case when a <> '' then a else b end as command, nullif(split_part({strip('c')}, chr(10), 1), '') as description
        from ({groups('t_scan', R.CLICK_COMMAND, ['a', 'b', 'c'], "suffix = '.py'")})"""
    t["t_cli_argparse"] = f"select repo, path as handler_file, a as command, nullif(b, '') as description from ({groups('t_scan', R.ARGPARSE_PARSER, ['a', 'b'], 'suffix = ' + q('.py'))})"
    kinds = ["flask", "fastapi", "django", "express", "next_pages", "next_app"]
    t["t_endpoints"] = union(f"select repo, {q(k)} as kind, handler_file, method, route from t_routes_{k}" for k in kinds)
    t["t_undocumented_routes"] = """select r.repo, count(e.route) as total_routes, count(*) filter (where e.route is not null and not f.has_docstring) as undocumented_routes
        from t_repos r left join t_endpoints e on e.repo = r.repo left join t_facts f on f.repo = e.repo and f.path = e.handler_file group by r.repo"""
    t["t_api_report"] = """select repo, case when total_routes > 0 and c > 0 then 'mixed' when c > 0 then 'cli' when total_routes > 0 then 'rest'
          when p then 'library' else 'rest' end as api_type, total_routes, c as total_commands, undocumented_routes from (
          select u.*, (select count(*) from t_cli_click c where c.repo = u.repo) + (select count(*) from t_cli_argparse c where c.repo = u.repo) as c,
            exists (select 1 from t_files f where f.repo = u.repo and f.path in ('setup.py', 'pyproject.toml')) as p from t_undocumented_routes u)"""

    # --- security
    t["t_secret_findings"] = union(
        f"select repo, {q(sev)} as severity, 'hardcoded-secret' as category, path as file, line, {q(f'Potential {name} detected: ')} || m as description from ({hits('t_scan', pattern, '1 as z')})"
        for name, pattern, sev in R.FILE_SECRETS
    )
    t["t_sql_source"] = f"select * from t_scan where suffix in {among(R.SQL_SUFFIXES)}"
    t["t_sql_injection"] = union(
        f"select repo, 'medium' as severity, 'sql-injection' as category, path as file, line, 'Potential SQL injection via string formatting: ' || m as description from ({hits('t_sql_source', pattern, '1 as z')})"
        for pattern, _ in R.SQL_INJECTION
    )
    finding = lambda sev, cat, text: f"{q(sev)} as severity, {q(cat)} as category, '.env' as file, cast(null as bigint) as line, {q(text)} as description"
    t["t_env_exposed"] = f"""select e.repo, {finding('high', 'env-file-exposed', R.ENV_EXPOSED)} from t_files e left join t_files g on g.repo = e.repo and g.path = '.gitignore'
        where e.path = '.env' and not contains(coalesce(g.content, ''), '.env')"""
    t["t_env_in_history"] = f"select repo, {finding('critical', 'env-file-in-git', R.ENV_IN_GIT)} from t_repos r where exists (select 1 from t_commit_files c where c.repo = r.repo and ends_with(c.path, '.env'))"
    compose = f"path in {among(R.COMPOSE_FILES)}"
    t["t_exposed_ports"] = f"""select distinct repo, port from (
          select repo, try_cast(unnest(list_concat(regexp_extract_all(content, {q(R.PORT_PAIR)}, 1), regexp_extract_all(content, {q(R.PORT_PAIR)}, 2))) as bigint) as port from t_files where {compose}
          union all select * from (select repo, try_cast(unnest(regexp_extract_all(content, {q(R.BARE_PORT)}, 1)) as bigint) as port from t_files where {compose}) where port between 1 and 65535)
        where port is not null"""
    auth = case([(f"regexp_matches(content, {q(p)})", q(n)) for n, p in R.AUTH_PATTERNS])
    t["t_auth_pattern"] = f"""select r.repo, a.auth as auth_pattern from t_repos r left join (select *, row_number() over (partition by repo order by suffix = '.js', parts) as k
        from (select repo, parts, suffix, {auth} as auth from t_scan where suffix in ('.py', '.js')) where auth is not null) a on a.repo = r.repo and a.k = 1"""
    t["t_security_findings"] = union(f"select * from t_{k}" for k in ("secret_findings", "sql_injection", "env_exposed", "env_in_history"))
    t["t_risk_level"] = """select r.repo, count(*) filter (where f.category = 'hardcoded-secret') as secrets_found,
          case when count(*) filter (where f.category = 'hardcoded-secret') > 0 then 'critical' when count(*) filter (where starts_with(f.category, 'env-file')) > 0 then 'high'
            when count(*) filter (where f.severity = 'medium') > 0 then 'medium' else 'low' end as risk_level
        from t_repos r left join t_security_findings f on f.repo = r.repo group by r.repo"""
    cat = lambda *c: f"select distinct repo from t_security_findings where category in {among(c)}"
    tests = [
        cat("hardcoded-secret"), cat("env-file-exposed", "env-file-in-git"), cat("sql-injection"),
        "select repo from t_auth_pattern where auth_pattern is null", "select distinct repo from t_exposed_ports where port in (80, 8080)",
    ]
    rules = union(f"select repo, {i} as o, {q(R.SECURITY_ADVICE[i])} as recommendation from ({x})" for i, x in enumerate(tests))
    t["t_advice"] = rules
    t["t_security_recommendations"] = f"""select repo, row_number() over (partition by repo order by o) - 1 as position, recommendation from (
        select * from t_advice union all select repo, 9, {q(R.SECURITY_ADVICE[-1])} from t_repos where repo not in (select repo from t_advice))"""
    return t


def setup_and_history() -> dict[str, str]:
    t: dict[str, str] = {}
    names = {
        "req": "requirements.txt", "ppt": "pyproject.toml", "pkg": "package.json", "gom": "go.mod", "cargo": "Cargo.toml", "cfg": "setup.cfg",
        "spy": "setup.py", "yarn": "yarn.lock", "pnpm": "pnpm-lock.yaml", "dock": "Dockerfile", "dc1": "docker-compose.yml", "dc2": "docker-compose.yaml", "envx": ".env.example",
    }
    t["t_roots"] = f"select repo, {', '.join(f'{root_text(p)} as {c}' for c, p in names.items())} from t_files group by repo"
    js = "case when json_valid(pkg) then pkg end"
    has_py = "(req is not null or spy is not null or cfg is not null or ppt is not null)"
    python = f"case when regexp_matches(ppt, {q(R.REQUIRES_PYTHON)}) then regexp_extract(ppt, {q(R.REQUIRES_PYTHON)}, 1) when regexp_matches(cfg, {q(R.CFG_PYTHON)}) then {strip(f'regexp_extract(cfg, {q(R.CFG_PYTHON)}, 1)')} end"
    pre = [
        (has_py, "python", python),
        ("pkg is not null", "node.js", f"json_extract_string({js}, '$.engines.node')"),
        ("(dc1 is not null or dc2 is not null or dock is not null)", "docker", "null"),
        ("gom is not null", "go", f"nullif(regexp_extract(gom, {q(R.GO_VERSION)}, 1), '')"),
        ("cargo is not null", "rust", "null"),
    ]
    rows = union(
        f"select repo, {i} as o, {q(n)} as name, cast({v} as varchar) as version, {q(R.PREREQUISITE_URLS[n])} as install_url from t_roots where {c}"
        for i, (c, n, v) in enumerate(pre)
    )
    number = "row_number() over (partition by repo order by o) as position"
    t["t_prerequisites"] = f"select repo, {number}, name, version, install_url from ({rows})"
    named = f"regexp_matches(coalesce({toml('ppt', 'project')}, ''), {q('(?m)^[ ' + chr(9) + ']*name' + chr(92) + 's*=' + chr(92) + 's*[' + chr(34) + chr(39) + '][^' + chr(34) + chr(39) + chr(10) + ']+[' + chr(34) + chr(39) + ']')})"
    tests = ["req is not null", f"ppt is not null and (req is null or {named})", "pkg is not null", "envx is not null", "gom is not null", "cargo is not null"]
    npm = "case when yarn is not null then 'yarn install' when pnpm is not null then 'pnpm install' else 'npm install' end"
    rows = union(
        f"select repo, {i} as o, {q(d)} as description, {npm if c == 'npm install' else q(c)} as command from t_roots where {x}"
        for i, ((d, c), x) in enumerate(zip(R.INSTALL_STEPS, tests))
    )
    t["t_install_steps"] = f"select repo, {number}, description, command from ({rows})"
    t["t_env_lines"] = f"""select repo, path, i, regexp_extract(s, {q(R.ENV_LINE)}, 1) as name, {strip(f'regexp_extract(s, {q(R.ENV_LINE)}, 2)')} as value from (
        select repo, path, {strip('unnest(l)')} as s, generate_subscripts(l, 1) as i from (select repo, path, {lines('content')} as l from t_files where path in ('.env', '.env.example')))
        where s <> '' and not starts_with(s, '#') and regexp_matches(s, {q(R.ENV_LINE)})"""
    t["t_env_vars"] = f"""with found as (
          select repo, name, 1 as o, i, value from t_env_lines where path = '.env.example'
          union all select repo, name, 2, 0, null from t_env_lines where path = '.env'
          union all select repo, unnest(regexp_extract_all(content, {q(R.PY_ENV)}, 1)), 3, 0, null from t_scan where suffix = '.py'
          union all select repo, unnest(regexp_extract_all(content, {q(R.JS_ENV)}, 1)), 4, 0, null from t_scan where suffix = '.js'
          union all select repo, unnest(regexp_extract_all(content, {q(R.JS_ENV)}, 1)), 5, 0, null from t_scan s where suffix = '.ts'
            and not exists (select 1 from t_facts j where j.repo = s.repo and j.suffix = '.js'))
        select repo, name, min(o) = 1 as required, nullif(max_by(value, i) filter (where o = 1), '') as example from found group by repo, name"""
    db = " or ".join(f"contains(content, {q(w)})" for w in R.DATABASE_WORDS)
    t["t_database_setup"] = f"select distinct repo, {q(R.DATABASE_STEP[0])} as description, {q(R.DATABASE_STEP[1])} as command from t_files where path in ('docker-compose.yml', 'docker-compose.yaml') and ({db})"
    readme_rank = case([(f"path = {q(n)}", str(i)) for i, n in enumerate(R.README_NAMES)])
    label = case([(f"contains(lower(c), {q(w)})", q(w.split()[0])) for w in R.RUN_KEYWORDS])
    t["t_run_lines"] = f"""select *, {label} as label from (select repo, o, bi, generate_subscripts(l, 1) as li, {strip('unnest(l)')} as c from (
        select repo, o, bi, {lines(strip('b'))} as l from (select repo, o, unnest(bs) as b, generate_subscripts(bs, 1) as bi from (
          select repo, {readme_rank} as o, regexp_extract_all(content, {q(R.RUN_BLOCK)}, 1) as bs from t_files where path in {among(R.README_NAMES)}))))"""
    script = lambda n: f"json_extract_string({js}, '$.scripts.{n}')"
    t["t_run_commands"] = f"""select repo, label, c as command from (select *, row_number() over (partition by repo, label order by o, bi, li) as k from t_run_lines where label is not null) where k = 1
        union all select repo, 'dev', 'npm run dev' from t_roots where {script('dev')} is not null
        union all select repo, 'start', 'npm start' from t_roots where {script('start')} is not null"""
    t["t_test_command"] = f"""select repo, case when contains(lower(coalesce(req, '')), 'pytest') or contains(lower(coalesce(ppt, '')), 'pytest') then 'pytest'
          when contains(lower({script('test')}), 'jest') then 'jest' when {script('test')} is not null then {script('test')}
          when gom is not null then 'go test ./...' when cargo is not null then 'cargo test' end as test_command from t_roots"""
    t["t_build_command"] = f"select repo, case when {script('build')} is not null then 'npm run build' end as build_command from t_roots"
    rows = union(
        f"select repo, {i} as o, {q(d)} as description, {q(s)} as solution from t_roots where {c}"
        for i, ((d, s), c) in enumerate(zip(R.COMMON_ISSUES, [has_py, "pkg is not null", "envx is not null"]))
    )
    t["t_common_issues"] = f"select repo, {number}, description, solution from ({rows})"

    # --- history
    t["t_head_commit"] = "select repo, commit_id as head_commit from (select *, row_number() over (partition by repo order by committed_at desc, commit_id desc) as k from t_commits) where k = 1"
    t["t_commit_count"] = "select repo, count(*) as commit_count from t_commits group by repo"
    t["t_authors"] = """select repo, author_name as name, author_email as email, count(*) as commits,
        max_by(commit_id, (committed_at, commit_id)) as newest_commit, max(committed_at) as newest_at
        from t_commits where not is_merge group by repo, author_name, author_email"""
    t["t_contributors"] = "select repo, name, email, commits, newest_commit from t_authors"
    t["t_recent_files"] = """select c.repo, f.path, max_by(c.commit_id, (c.committed_at, c.commit_id)) as last_commit
        from t_commits c join t_commit_files f on f.repo = c.repo and f.commit_id = c.commit_id where not c.is_merge group by c.repo, f.path"""
    return t


def scores() -> dict[str, str]:
    t: dict[str, str] = {}
    security = case([(f"x.risk_level = {q(k)}", str(v)) for k, v in R.SECURITY_SCORE.items()], "50")
    parts = [
        ("tech_debt", "Tech Debt", "select repo, 100 - score as s, grade as g from t_debt_score"),
        ("architecture", "Architecture", f"select distinct repo, {R.ARCHITECTURE_SCORE} as s, null as g from t_tree"),
        ("dependencies", "Dependencies", "select repo, 100 - risk_score as s, null as g from t_dependency_risk"),
        ("conventions", "Conventions", "select repo, consistency_score as s, null as g from t_consistency_score"),
        ("api", "API", "select repo, case when total_routes = 0 then 100 else trunc((1 - undocumented_routes::double / total_routes) * 100) end as s, null as g from t_undocumented_routes"),
        ("security", "Security", f"select repo, {security} as s, null as g from t_risk_level x"),
        ("onboarding", "Onboarding", "select distinct repo, case when repo in (select repo from t_setup_steps) then 80 else 50 end as s, null as g from t_tree"),
        ("setup", "Setup", "select repo, case when repo in (select repo from t_prerequisites) then 80 else 50 end as s, null as g from t_repos"),
    ]
    rows = union(
        f"select repo, {i + 1}::bigint as position, {q(k)} as analysis, {q(label)} as label, cast(s as integer) as score, cast(g as varchar) as g from ({x})"
        for i, (k, label, x) in enumerate(parts)
    )
    t["t_scorecard"] = f"""select repo, position, analysis, label, score, coalesce(g, {ladder('score', R.HEALTH_GRADES, 'F', '>=')}) as grade,
        {ladder('score', R.SCORE_COLOURS, R.WORST_COLOUR, '>=')} as colour from ({rows})"""
    t["t_overall_health"] = f"""select repo, overall, {ladder('overall', R.HEALTH_GRADES, 'F', '>=')} as overall_grade from (
        select repo, cast(trunc(sum(score)::double / count(*)) as integer) as overall from t_scorecard group by repo)"""
    badge = case([(f"grade = {q(k)}", q(v)) for k, v in R.BADGE_COLOURS.items()], q(R.UNKNOWN_BADGE))
    t["t_score_band"] = f"""select repo, score, grade, {ladder('score', R.DEBT_COLOURS, R.WORST_COLOUR, '<=')} as debt_colour,
        {ladder('(100 - score)', R.SCORE_COLOURS, R.WORST_COLOUR, '>=')} as health_colour, {badge} as badge_colour from t_debt_score"""
    return t


def reports() -> dict[str, str]:
    t: dict[str, str] = {}
    lists = [
        ("architecture", "entry_points", "entry_points", "entry_type path"),
        ("architecture", "layers", "layers", "layer path purpose"),
        ("architecture", "internal_deps", "import_edges", "from_module to_module"),
        ("api", "endpoints", "endpoints", "handler_file kind method route"),
        ("api", "cli_commands", "cli_commands", "command description handler_file kind"),
        ("security", "findings", "security_findings", "category description file line severity"),
        ("setup", "env_vars", "env_vars", "example name required"),
    ]
    t["t_cli_commands"] = "select repo, 'click' as kind, * exclude (repo) from t_cli_click union all select repo, 'argparse', * exclude (repo) from t_cli_argparse"
    rows = []
    for section, name, table, fields in lists:
        item = ", ".join(f"{q(f)}, {f}" for f in fields.split())
        rows.append(f"select repo, {q(section)} as section, {q(name)} as list, cast(json_object({item}) as varchar) as item from t_{table}")
    t["t_report_items"] = union(rows)
    n = lambda table: f"(select count(*) from t_{table} x where x.repo = r.repo)"
    t["t_snapshot_read"] = f"""select 'current' as snapshot_id, r.repo, h.head_commit, a.project_type, a.framework, a.structure_pattern, a.total_files, a.total_lines,
          a.entry_point_count, a.edge_count, d.score as overall_score, d.grade, s.project_summary, o.architecture_overview, m.package_manager,
          k.total_deps, k.outdated_count, k.risk_score, c.* exclude (repo), p.api_type, p.total_routes, p.total_commands, p.undocumented_routes,
          l.risk_level, l.secrets_found, u.auth_pattern, b.build_command, t.test_command,
          {n('key_files')} as key_file_count, {n('hotspots')} as hotspot_count, {n('debt_recommendations')} as recommendation_count,
          {n('setup_steps')} as setup_step_count, {n('test_commands')} as test_command_count, {n('gotchas')} as gotcha_count,
          {n('first_terms')} as term_count, {n('top_contributors')} as contributor_count, {n('exposed_ports')} as port_count,
          {n('security_recommendations')} as advice_count, {n('prerequisites')} as prerequisite_count, {n('install_steps')} as install_step_count,
          {n('run_commands')} as run_command_count, {n('common_issues')} as issue_count
        from t_repos r left join t_head_commit h using (repo) left join t_architecture_report a using (repo) left join t_debt_score d using (repo)
        left join t_readme_summary s using (repo) left join t_architecture_overview o using (repo) left join t_package_manager m using (repo)
        left join t_dependency_risk k using (repo) left join t_convention_report c using (repo) left join t_api_report p using (repo)
        left join t_risk_level l using (repo) left join t_auth_pattern u using (repo) left join t_build_command b using (repo) left join t_test_command t using (repo)"""
    lists = {
        "key_files": ("key_files", "path || '|' || role || '|' || importance_score", "rank"),
        "hotspots": ("hotspots", "path || '|' || reason || '|' || score", "rank"),
        "debt_advice": ("debt_recommendations", "recommendation", "rank"),
        "setup_commands": ("setup_steps", "command", "position"), "test_commands": ("test_commands", "command", "position"),
        "gotchas": ("gotchas", "gotcha", "position"), "terms": ("first_terms", "term || '|' || meaning", "term"),
        "contributors": ("top_contributors", "name || '|' || email || '|' || recent_commits", "rank"),
        "packages": ("dependencies", "name || '|' || current_version || '|' || status", "position"),
        "ports": ("exposed_ports", "cast(port as varchar)", "port"),
        "security_advice": ("security_recommendations", "recommendation", "position"),
        "install_commands": ("install_steps", "command", "position"), "issues": ("common_issues", "description", "position"),
    }
    t["t_full_report"] = "select * exclude (snapshot_id), " + ", ".join(
        f"coalesce((select string_agg({text}, chr(10) order by {order}) from t_{table} x where x.repo = s.repo), '') as {name}"
        for name, (table, text, order) in lists.items()
    ) + " from t_snapshot_read s"
    t["t_snapshot_write"] = "select 'current' as snapshot_id, repo, 11::bigint as field_count from t_repos"
    return t


LATER = {"new": "t_later_files", "third": "t_third_files", "fourth": "t_fourth_files", "fifth": "t_fifth_files"}
SHARED = {"t_templates", "t_documents", "t_all_files", *LATER.values(), "t_commits", "t_commit_files", "t_suffix_language"}
BIG = {"t_all_files", *LATER.values(), "t_declared", "t_clauses", "t_license_notices", "t_symbols", "t_public", "t_links", "t_led", "t_files", "t_facts", "t_tree", "t_scan", "t_ignored", "t_debt_counts", "t_sample", "t_commit_files", "t_security_findings"}


def needed(names: list[str], library: dict[str, str]) -> list[str]:
    """Names with everything they refer to, each after what it depends on."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for ref in dict.fromkeys(re.findall(r"\bt_\w+", library[name])):
            if ref in library and ref != name:
                visit(ref)
        if name not in done:
            done.append(name)

    for name in names:
        visit(name)
    return done


def with_clause(entries: dict[str, str]) -> str:
    base = lambda n: re.sub(rf"_({'|'.join(LATER)})$", "", n)
    return "WITH RECURSIVE " + ",\n".join(
        f"{n} AS {'MATERIALIZED ' if base(n) in BIG else ''}({sql})" for n, sql in entries.items()
    )


def statement(key: str) -> str:
    library = tables()
    name = f"t_{key}"
    entries = {n: library[n] for n in needed([name], library)}
    return f"{with_clause(entries)}\nSELECT * FROM {name}"


def later(key: str, state: str = "new") -> dict[str, str]:
    """Entries of a query over a later state of the corpus, renamed."""
    library = dict(tables())
    library["t_files"] = f"select * from {LATER[state]}"
    entries = {}
    for name in needed([f"t_{key}"], library):
        renamed = name if name in SHARED else f"{name}_{state}"
        entries[renamed] = re.sub(
            r"\b(t_\w+)", lambda m: m[1] if m[1] in SHARED or m[1] not in library else f"{m[1]}_{state}", library[name]
        )
    return entries


def trend() -> str:
    """Scores of five states at five days, each compared with the one before, and the line through all of them."""
    library = tables()
    entries = {n: library[n] for n in needed(["t_debt_score"], library)}
    for state in LATER:
        entries |= later("debt_score", state)
    states = {"now": ("", 0), "later": ("_new", 7), "third": ("_third", 21), "fourth": ("_fourth", 28), "fifth": ("_fifth", 60)}
    log = union(
        f"select repo, {q(name)} as snapshot_id, {20454 + day}::bigint as day, score, grade from t_debt_score{suffix}"
        for name, (suffix, day) in states.items()
    )
    return f"""{with_clause(entries)}, log AS ({log}),
    line AS (select repo, count(*) as n, sum(day - 20454) as sx, sum(score) as sy, sum((day - 20454) * score) as sxy, sum((day - 20454) * (day - 20454)) as sxx
      from log group by repo),
    slopes AS (select repo, (n * sxy - sx * sy)::double / nullif(n * sxx - sx * sx, 0)::double as slope from line)
    select repo, row_number() over w as position, snapshot_id, day, score, grade, score - lag(score) over w as change,
      score - first(score) over w as change_so_far, slope,
      case when slope > 0 then 'worsening' when slope < 0 then 'improving' when slope = 0 then 'steady' else 'unknown' end as direction
    from log join slopes using (repo) window w as (partition by repo order by day)"""


def difference(key: str, final: str) -> str:
    library = tables()
    now = {n: library[n] for n in needed([f"t_{key}"], library)}
    return f"{with_clause({**now, **later(key)})}\n{final}"


def changed(key: str, columns: str, added: str, removed: str) -> str:
    old, new = (f"select {columns} from t_{key}{s}" for s in ("", "_new"))
    return difference(
        key, f"select *, {q(added)} as change from ({new} except {old}) union all select *, {q(removed)} from ({old} except {new})"
    )


def diff_statements() -> dict[str, str]:
    rank = lambda c: case([(f"{c} = {q(k)}", str(v)) for k, v in R.GRADE_RANK.items()], "0")
    grade = f"""select repo, o.grade as old_grade, n.grade as new_grade, coalesce({rank('n.grade')} > {rank('o.grade')} and o.grade is not null and n.grade is not null, false) as grade_improved,
        n.score - o.score as score_change from t_debt_score o full join t_debt_score_new n using (repo)"""
    return {
        "diff_grade": difference("debt_score", grade),
        "diff_findings": changed("security_findings", "*", "new", "resolved"),
        "diff_key_files": changed("scored_files", "repo, path", "new", "deleted"),
        "debt_trend": trend(),
        "diff_recommendations": changed("debt_recommendations", "repo, recommendation", "new", "resolved"),
    }


def statements(keys) -> dict[str, str]:
    library, diffs = tables(), diff_statements()
    return {k: diffs[k] if k in diffs else statement(k) for k in keys if k in diffs or f"t_{k}" in library}
