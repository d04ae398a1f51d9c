"""SQL equivalents of the registered queries, for DuckDB over the same tables.

Written from the definitions with ranked windows and recursive queries, independently of
how the operators compute them.
"""

from __future__ import annotations


def canon(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), '-', ' '), '\\s+', ' ', 'g'))"


PAPERS = """
papers as (
  select cast(o_orderkey as varchar) as pid,
         concat('Order ', o_orderkey, ' placed by customer number ', o_custkey) as title,
         case when o_orderstatus = 'P' then '' else
           concat(o_orderpriority, ' value ', cast(floor(o_totalprice / 1000) as bigint)) end as problem,
         replace(o_orderpriority, '-', '|') as task,
         case o_orderstatus when 'F' then 'general' when 'O' then 'medical' else '' end as domain,
         case o_orderpriority when '1-URGENT' then 'technique' when '2-HIGH' then 'benchmark'
           when '3-MEDIUM' then 'technique' when '4-NOT SPECIFIED' then 'survey' else 'other' end as paper_type
  from orders)"""

LEX = """
lex as (
  select p_partkey as ord, concat('Part-', p_partkey) as name,
         concat('maker ', p_size) as a1, concat('SKU-', p_partkey) as a2, p_size,
         case when p_size <= 20 then 'approved' when p_size <= 35 then 'unreviewed'
           when p_size <= 42 then 'pending' else 'rejected' end as status,
         case when p_type in ('SMALL', 'MEDIUM') then p_name else '' end as definition,
         case when p_size <= 20 then 'seed' else p_brand end as source, '' as first_seen
  from part)"""

MENTIONS = f"""
raw as (
  select cast(l_orderkey as varchar) as pid, case when l_linenumber = 1 then 0 else 1 end as phase,
         row_number() over (order by l_linenumber, l_partkey, l_suppkey) as pos,
         case l_returnflag when 'A' then concat('Part-', l_partkey)
           when 'R' then concat(' sku  ', l_partkey) when 'N' then case when l_suppkey % 2 = 0
           then concat('Maker-', l_suppkey) else concat('Tool-', l_suppkey, '-', l_partkey % 7) end end as name,
         case when l_linenumber = 1 and l_discount >= 0.05 then
           concat('uses ', cast(l_quantity as bigint), ' ', l_linestatus) else '' end as definition
  from lineitem),
m as materialized (select *, {canon('name')} as key from raw)"""

RESOLVE = f"""
entries as (
  select ord, 0 as slot, {canon('name')} as rk, {canon('name')} as key from lex
  union all select ord, 1, {canon('name')}, {canon('a1')} from lex
  union all select ord, 2, {canon('name')}, {canon('a2')} from lex),
alias_map as (
  select key, rk from entries qualify row_number() over (partition by key order by ord desc, slot desc) = 1),
reps as (
  select {canon('name')} as rk, name as label, status, definition as lex_definition from lex
  qualify row_number() over (partition by {canon('name')} order by ord desc) = 1),
unknown as (select * from m where key not in (select key from alias_map))"""


def _registered(order: str, keep_text: bool) -> str:
    text = "case when phase = 0 then definition else '' end" if keep_text else "''"
    return f"""
fresh as (
  select key as rk, name as label, case when phase = 0 then 'unreviewed' else 'pending' end as status,
         {text} as definition, case when phase = 0 then 'defines' else 'builds_on' end as source,
         pid as first_seen
  from unknown qualify row_number() over (partition by key order by {order}) = 1),
res as materialized (
  select m.*, coalesce(a.rk, m.key) as rk, coalesce(r.label, f.label) as label,
         coalesce(r.status, f.status) as status, coalesce(r.lex_definition, f.definition) as lex_definition,
         coalesce(coalesce(r.status, f.status) in ('approved', 'unreviewed'), false) as ok
  from m left join alias_map a on m.key = a.key left join reps r on a.rk = r.rk
         left join fresh f on a.rk is null and f.rk = m.key)"""


V1 = ",".join([PAPERS, LEX, MENTIONS, RESOLVE, _registered("phase, pid, pos", True)]) + """,
d as (select * from res where phase = 0 and ok
      qualify row_number() over (partition by rk order by pid, pos) = 1),
pseudo as (select * from papers where pid not in (select pid from raw where phase = 0)),
n_def as (select rk, count(distinct pid) as n_papers from res where phase = 0 and ok group by rk),
nodes as (
  select d.rk as key, d.label as canonical,
         case when d.definition <> '' then d.definition else d.lex_definition end as definition,
         d.pid as def_source, p.domain, p.paper_type as ptype, d.status, n.n_papers
  from d join papers p on d.pid = p.pid join n_def n on d.rk = n.rk
  union all
  select distinct rk, label, lex_definition, '', 'general', 'technique', status, 0
  from res where phase = 1 and ok and rk not in (select rk from d)
  union all
  select concat('paper:', pid), left(title, 40), problem, pid, domain, paper_type, 'approved', 1 from pseudo),
v1_nodes as (
  select *, case when definition <> '' and ptype = 'technique' then 'ok'
              when ptype in ('analysis', 'benchmark', 'survey') then 'n/a' else 'placeholder' end as def_status
  from nodes)
"""

V2 = ",".join([PAPERS, LEX, MENTIONS, RESOLVE, _registered("pid, phase, pos", False)]) + """,
edges as materialized (
  select pid, phase, pos, case when phase = 0 then 'defines' else 'builds_on' end as type, rk, label, status,
         case when phase = 0 then definition else '' end as definition
  from res where ok),
firsts as (select * from edges qualify row_number() over (partition by rk order by pid, phase, pos) = 1),
texts as (select * from edges where definition <> ''
          qualify row_number() over (partition by rk order by pid, phase, pos) = 1),
concepts as materialized (
  select f.rk, f.label as canonical, coalesce(t.definition, '') as definition,
         case when t.rk is not null or f.phase = 0 then 'ok' else 'placeholder' end as def_status, f.status
  from firsts f left join texts t on f.rk = t.rk),
homes as (select * from edges where phase = 0
          qualify row_number() over (partition by rk order by pid, phase, pos) = 1),
months as (
  select rk, count(distinct pid) as n_papers,
         min(case when regexp_matches(left(pid, 4), '^[0-9]{4}$')
             then concat('20', substr(pid, 1, 2), '-', substr(pid, 3, 2)) end) as month
  from edges group by rk),
view_nodes as materialized (
  select c.rk as id, c.canonical, c.definition, c.def_status, c.status, m.n_papers, m.month,
         case when coalesce(p.paper_type, '') = '' then 'technique' else p.paper_type end as ptype,
         case when coalesce(p.domain, '') = '' then 'general' else p.domain end as domain
  from concepts c join months m on c.rk = m.rk
       left join homes h on c.rk = h.rk left join papers p on h.pid = p.pid),
main as (select pid, rk from edges where phase = 0
         qualify row_number() over (partition by pid order by pos) = 1),
lineage as materialized (
  select distinct main.rk as src, e.rk as dst
  from edges e join main on e.pid = main.pid where e.phase = 1 and e.rk <> main.rk)
"""


def v1(select: str) -> str:
    return f"with {V1} {select}"


def v2(select: str) -> str:
    return f"with {V2} {select}"


START = "(select src from lineage group by src order by count(*) desc, src limit 1)"
UP = """up as (select src as id from start_node union
  select l.dst from up join lineage l on l.src = up.id)"""
DOWN = """down as (select src as id from start_node union
  select l.src from down join lineage l on l.dst = down.id)"""


def closure(parts: str, select: str) -> str:
    return f"with recursive {V2}, start_node as {START}, {parts} {select}"


LEX_ONLY = f"with {LEX}"

VEC = """
v as (select vec_id as id, embedding::double[] as vec, label from embeddings),
q as (select vec as qv from v order by id limit 1)"""
SIMS = f"with {VEC}" + """,
sims as materialized (
  select a.id as a, b.id as b, round(list_cosine_similarity(a.vec, b.vec), 3) + 0.0 as sim, a.label = b.label as same
  from v a join v b on a.id < b.id)
"""
REP_SIMS = f"with {VEC}" + """,
reps as (
  select min(id) as id, vec, count(*) as n from v where {labels} group by vec),
rows as materialized (
  select 'problem' as field, a.id as a, b.id as b,
         round(list_cosine_similarity(a.vec, b.vec), 3) + 0.0 as sim, a.n * b.n as node_pairs
  from reps a join reps b on a.id < b.id
  union all
  select 'problem', id, id, 1.0, n * (n - 1) // 2 from reps where n > 1)
"""
HITS = f"with {VEC}" + """,
scored as (select id, label, list_cosine_similarity(vec, qv) as score from v, q),
hits as (
  select id, score, label >= 5 as paper from scored where score >= 0.30
  qualify row_number() over (partition by label >= 5 order by score desc, id) <= 8)
"""

FEED = """
k as (select *, cast(json_extract_string(props, '$.k') as integer) as k from events),
feed as (
  select list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) * 1000 + k as query_ord,
         concat(event_type, ' ', k) as query, event_id as entry_ord,
         concat('24', lpad(cast(user_id % 12 + 1 as varchar), 2, '0'), '.', user_id) as aid, concat('Paper number ', user_id) as title, event_type as abstract,
         strftime(ts + to_days(k * 10), '%Y-%m-%dT%H:%M:%SZ') as stamp
  from k),
ranked as (
  select *, cast(row_number() over (partition by query_ord order by stamp desc, entry_ord) as integer) as rank from feed)
"""

FOUND = """
found as (
  select cast(doc_id as varchar) as aid, concat(source, ' ', lang) as title, text as abstract,
         case when lang = 'en' then '2024-05-01' else '' end as published,
         concat(lang, '|', source) as categories, lang as first_seen_query
  from documents),
ledger as (
  select cast(doc_id as varchar) as aid, case when quality = 0 then 'Reject' else 'technique' end as verdict,
         case when toxic = 1 then 'gate-v0' else 'gate-v1' end as prompt_ver, quality = 1 as extracted
  from labels)
"""
FATE = f"with {FOUND}" + """,
fates as (
  select f.aid, f.title, case when f.aid in (select cast(conv_id as varchar) from conversations) then 'owned'
         when lower(l.verdict) in ('reject', 'rejected', 'drop') then 'gate' else 'new' end as fate
  from found f left join ledger l on f.aid = l.aid)
"""
GATE = f"with {FOUND}" + """,
merged as (
  select coalesce(f.aid, l.aid) as aid, f.aid is not null as asked, l.verdict, l.prompt_ver,
         lower(concat(coalesce(f.title, ''), ' ', coalesce(f.abstract, ''))) as body
  from found f full join ledger l on f.aid = l.aid),
gate as (
  select aid, asked, coalesce(prompt_ver = 'gate-v1', false) as cached, verdict as old, prompt_ver as old_ver,
         case when prompt_ver = 'gate-v1' then verdict
              when contains(body, 'thing') then 'survey' when contains(body, 'eaux') then 'benchmark'
              when contains(body, 'inth') then 'analysis' else 'technique' end as verdict
  from merged)
"""

CONTENTS = f"""
parts as (
  select p_partkey as pid, concat(p_name, ' number ', p_partkey) as title, p_name as task,
         p_type <> 'PROMO' as defines, p_brand as name, concat(p_name, ' ', p_size) as definition,
         case when p_size > 25 then p_type else '' end as problem
  from part)"""

PAGE_SUMS = """
kept as (
  select * from (
    select *, coalesce(sum(length(text)) over (partition by paper_id order by page
                       rows between unbounded preceding and 1 preceding), 0) as before
    from pages_of) where before < {budget}),
whole as (select paper_id, string_agg(text, '' order by page) as t from kept group by paper_id)"""

LINE_PAGES = """
pages_of as (
  select doc_id as paper_id, unnest(range(len(string_split(text, chr(10))))) as page,
         unnest(string_split(text, chr(10))) as text from documents)"""

TALK_PAGES = """
pages_of as (
  select conv_id as paper_id, turn as page,
         concat(case role when 'user' then 'Abstract' || chr(10)
                  when 'assistant' then chr(10) || ' ' || chr(10) || '2. Related Work' || chr(10)
                  else chr(10) || '## 2 Setup' || chr(10) end, text) as text
  from conversations)"""

HEADS = r"(?:2\s+[A-Z]|2\.\s+[A-Z]|##?\s*2\b|related work|background|preliminaries|2\s+related)"


def cut(source: str, key: str, column: str, rest: str = "head6000", head: str = "left(t, 6000)") -> str:
    """Start at the word "abstract"; the end is the first newline, at least 50 characters
    later, that a section head follows."""
    return f"""
started as (
  select {key}, {column} as t,
         case when regexp_matches({column}, '(?i)\\babstract\\b')
              then length(regexp_extract({column}, '(?is)^(.*?)\\babstract\\b', 1)) else 0 end as st
  from {source}),
tails as (select *, substr(t, st + 50) as tail from started),
cuts as (
  select {key}, case when regexp_matches(tail, '(?i)\\n\\s*{HEADS}')
                then concat(substr(t, st + 1, 49),
                            regexp_extract(tail, '(?is)^(.*?\\n)\\s*{HEADS}', 1)) end as section, t
  from tails),
done as (
  select {key}, case when section is not null then 'section' else '{rest}' end as cut_method,
         coalesce(section, {head}) as text from cuts)"""


def embedded(source: str, keys: str) -> str:
    """vectors(keys, vec): hashed character trigrams with unit length."""
    digit = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
    return f"""
grams as (
  select {keys}, md5(substr(t, cast(spot as int), 3)) as h from (
    select {keys}, concat('  ', lower(text), ' ') as t, unnest(range(1, length(text) + 2)) as spot from {source} where trim(text) <> '')),
counts as (
  select {keys}, ({digit.format(1)} * 16 + {digit.format(2)}) % 64 as place,
         sum(case when {digit.format(3)} < 8 then 1 else -1 end) as n from grams group by all),
lengths as (select {keys}, sqrt(sum(n * n)::double) as length from counts group by all),
vectors as (
  select {keys}, list(coalesce(n, 0) / case when length = 0 then 1 else length end order by place) as vec
  from (select *, unnest(range(64)) as place from lengths) left join counts using ({keys}, place) group by {keys})"""


ORACLES: dict[str, str] = {
    "canon_names": f"""
      with n as (
        select concat('  ', p_brand, '-', p_name, '  ', p_type) as name from part
        union all select concat(c_name, '-', c_mktsegment) from customer
        union all select r_name from region)
      select {canon('name')} as key, count(*) as n from n group by 1""",
    "alias_resolve": f"""
      with {LEX}, {MENTIONS}, {RESOLVE}
      select coalesce(a.rk, m.key) as rk, coalesce(r.label, m.name) as label, r.status,
             a.rk is not null as found, count(*) as n
      from m left join alias_map a on m.key = a.key left join reps r on a.rk = r.rk group by all""",
    "lexicon_rows": f"""{LEX_ONLY}
      select ord, name, concat(a1, '|', a2) as aliases, status, definition, source, first_seen from lex""",
    "lexicon_register_v1": v1("select rk, label, status, definition, source, first_seen from fresh"),
    "lexicon_register_v2": v2("select rk, label, status, definition, source, first_seen from fresh"),
    "registration_counts": v1("select status, count(*) as n from fresh group by 1"),
    "lexicon_after_rebuild": v1("""
      , firsts as (select key, phase, pid, pos from unknown
                   qualify row_number() over (partition by key order by phase, pid, pos) = 1)
      select ord, name, status, definition, source, first_seen from lex
      union all
      select (select max(ord) from lex) + row_number() over (order by f.phase, f.pid, f.pos),
             label, status, definition, source, first_seen
      from fresh join firsts f on fresh.rk = f.key"""),
    "status_counts": f"{LEX_ONLY} select status, count(*) as n from lex group by 1",
    "lexicon_sorted": f"""{LEX_ONLY}
      select row_number() over (order by lower(source) desc, ord) - 1 as rank, name, source, ord
      from lex where status = 'pending'""",
    "lexicon_search": f"""{LEX_ONLY}
      select status, contains(lower(name), 'rt-1') as matched, count(*) as n from lex group by all""",
    "lexicon_patch": f"""{LEX_ONLY}
      , patches as (
        select concat('Part-', s_suppkey % 40 + 1) as name,
               max(s_suppkey) filter (where s_acctbal < 5000) is not null as approve, max_by(s_name, s_suppkey) as text
        from supplier group by 1)
      select name, case when approve then 'approved' else status end as status,
             coalesce(text, definition) as definition, source
      from lex left join patches using (name)""",
    "lexicon_merge": LEX_ONLY.replace("with", "with recursive", 1) + """,
      step as (select c_custkey + 25 as src, (c_custkey + 25) // 5 as dst, c_custkey as seq from customer
               where c_custkey + 25 in (select ord from lex) and (c_custkey + 25) // 5 in (select ord from lex)),
      up as (
        select src, dst as root, [struct_pack(seq := seq, name := concat('Part-', src))] as path from step
        union all
        select u.src, s.dst, list_concat([struct_pack(seq := s.seq, name := concat('Part-', s.src))], u.path)
        from up u join step s on s.src = u.root),
      found as (select * from up where root not in (select src from step)),
      own as (select concat('Part-', ord) as name, slot, alias
              from (select ord, 0 as slot, a1 as alias from lex union all select ord, 1, a2 from lex)
              where ord not in (select src from step)),
      brought as (
        select concat('Part-', root) as name, path, -1 as slot, concat('Part-', src) as alias from found
        union all select concat('Part-', root), path, 0, a1 from found join lex on ord = src
        union all select concat('Part-', root), path, 1, a2 from found join lex on ord = src),
      fresh as (
        select name, path, slot, alias from brought
        where alias <> name and (name, alias) not in (select (name, alias) from own)
        qualify row_number() over (partition by name, alias order by path, slot) = 1),
      every as (select name, []::struct(seq bigint, name varchar)[] as path, slot, alias from own union all select * from fresh)
      select name, row_number() over (partition by name order by path, slot, alias) - 1 as place, alias from every""",
    "bulk_plan_check": f"""{LEX_ONLY},
      plan as (select concat('Part-', p_partkey) as name from part
               where (p_size between 36 and 42 or p_size = 50) and p_partkey <> 1),
      d as (
        select name, 'missing' as problem from plan where name not in (select name from lex)
        union all select name, 'unplanned' from lex where status = 'pending' and name not in (select name from plan)
        union all select name, 'not_pending' from lex
                  where status <> 'pending' and name in (select name from plan))
      select *, row_number() over (order by problem, name) - 1 as rank from d""",
    "bulk_classify": f"""{LEX_ONLY},
      goal as (select min(ord) as goal from lex where p_size = 20),
      gone as (select name, a1, a2 from lex where p_size = 42),
      changed as (
        select case when l.status = 'pending' then
                 case when p_retailprice < 1000 then 'approved' else 'rejected' end else l.status end as status,
               2 + case when ord = goal then (select count(distinct x) from (
                 select name as x from gone union all select a1 from gone union all select a2 from gone)) else 0 end as n_aliases
        from lex l join part on p_partkey = ord, goal where l.p_size <> 42 or l.status <> 'pending')
      select status, count(*) as n, cast(sum(n_aliases) as bigint) as n_aliases from changed group by 1""",
    "alias_edit": f"""{LEX_ONLY}
      select name, concat(a1, '|', a2) as same, concat(a1, '|', a2, '|', source) as added, a2 as removed from lex""",
    "graph_v1_nodes": v1("select * from v1_nodes"),
    "graph_v1_node_papers": v1("""
      select distinct rk as key, pid from res where phase = 0 and ok
      union all select concat('paper:', pid), pid from pseudo"""),
    "graph_v1_edges": v1("""
      , home as (
        select pid, rk as src from res where phase = 0
        qualify row_number() over (partition by pid order by pos) = 1
        union all select pid, concat('paper:', pid) from pseudo)
      select distinct src, rk as dst from res join home using (pid)
      where phase = 1 and ok and src in (select key from v1_nodes)"""),
    "blocked_refs": v1("""
      , b as (select name, count(*) as n, min(struct_pack(pid := pid, pos := pos)) as spot
              from res where phase = 1 and not ok group by 1)
      select row_number() over (order by n desc, spot) - 1 as rank, name, n from b"""),
    "graph_v2_concepts": v2("select * from concepts"),
    "graph_v2_papers": f"with {PAPERS} select * from papers",
    "graph_v2_edges": v2("select pid, type, rk, count(*) as n from edges group by all"),
    "graph_v2_counts": v2("""
      select 'papers' as kind, count(*) as n from papers
      union all select 'concepts', count(*) from concepts
      union all select 'placeholders', count(*) from concepts where def_status = 'placeholder'
      union all select type, count(*) from edges group by type"""),
    "view_concepts": v2("select * from view_nodes"),
    "view_concept_papers": v2("select distinct rk, pid from edges"),
    "view_builds_on": v2("select * from lineage"),
    "view_nodes_by_type": v2("""
      select 'concept' as type, domain, count(*) as n, 0 as titled, count(*) as named from view_nodes group by domain
      union all select 'paper', domain, count(*), count(*), 0 from papers group by domain"""),
    "view_paper_defines": v2("""
      select concat('paper:', pid) as src, rk as dst, count(*) as n from edges where phase = 0 group by all"""),
    "view_paper_anchors": v2("""
      select concat('paper:', pid) as src, rk as dst, count(*) as n from edges
      where phase = 1 and pid not in (select pid from edges where phase = 0) group by all"""),
    "graph_filter": v2("""
      select id, canonical, month from view_nodes
      where ptype = 'technique' and domain = 'medical' and month >= '2010-05'"""),
    "concept_search": v2("select id, canonical from view_nodes where contains(lower(canonical), 'rt-12')"),
    "concept_names": v2("select row_number() over (order by canonical) - 1 as rank, canonical from concepts"),
    "induced_subgraph": v2("""
      select src, dst from lineage where src in (select id from view_nodes where domain = 'general')
        and dst in (select id from view_nodes where domain = 'general')"""),
    "graph_links": v2("""
      select src as source, dst as target, 'builds_on' as kind, ptype as from_type
      from lineage join view_nodes on id = src"""),
    "graph_export_nodes": v2("""
      select id, canonical as label, def_status, ptype, def_status = 'ok' as has_def, definition, n_papers, domain
      from view_nodes"""),
    "rebuild_counts": v1("""
      , main as (select pid, rk from res where phase = 0 and ok
                 qualify row_number() over (partition by pid order by pos) = 1)
      select (select count(distinct rk) from res where ok) as nodes,
             (select count(*) from (
                select distinct main.rk as src, res.rk as dst from res join main using (pid)
                where phase = 1 and ok and res.rk <> main.rk)) as builds_on"""),
    "lineage_ancestors": closure(UP, """
      select 'ancestor' as side, id from up where id not in (select src from start_node)"""),
    "lineage_descendants": closure(DOWN, """
      select 'descendant' as side, id from down where id not in (select src from start_node)"""),
    "lineage_both": closure(f"{UP}, {DOWN}", """
      select id, count(*) as sides from (select id from up union all select id from down)
      where id not in (select src from start_node) group by id"""),
    "node_texts": v1("""
      select key as id, case when trim(definition) <> '' then concat(canonical, ': ', trim(definition))
             else concat(canonical, ' (', ptype, ')') end as text from v1_nodes"""),
    "embed_texts_v2": v2("""
      select concat('concept:', rk) as id, nullif(trim(definition), '') as text from concepts
      union all select concat('paper:', pid), nullif(trim(problem), '') from papers"""),
    "text_fallbacks": v1("select count(*) filter (where trim(definition) = '') as without_definition from v1_nodes"),
    "field_texts": f"""
      with {CONTENTS}
      select {canon('name')} as key, name as label, definition as define, problem, task from parts where defines
      qualify row_number() over (partition by {canon('name')} order by pid desc) = 1
      union all
      select concat('paper:', pid), left(title, 30), title, problem, task from parts where not defines""",
    "records_to_mentions": f"""
      with {CONTENTS}
      select pid, 0 as phase, 0 as pos, name, definition from parts where defines
      union all
      select pid, 1, cast(u.at - 1 as int), u.word, '' from (
        select pid, unnest(string_split(task, ' ')) as word, generate_subscripts(string_split(task, ' '), 1) as at from parts) u""",
    "defined_name_lists": f"with {CONTENTS} select pid, case when defines then name else '(none)' end as names from parts",
    "plain_ids": v2("""
      select id, case when id like 'concept:%' then substr(id, 9) else substr(id, 7) end as plain
      from (select concat('concept:', rk) as id from concepts union all select concat('paper:', pid) from papers)"""),
    "field_texts_of_graph": f"""
      with {CONTENTS},
      texts as (
        select {canon('name')} as key, name as label, definition as define, problem, task from parts where defines
        qualify row_number() over (partition by {canon('name')} order by pid desc) = 1)
      select * from texts where key in (select {canon('p_brand')} from part where p_size <= 20)""",
    "lineage_counts": closure(f"{UP}, {DOWN}", """
      select (select count(*) - 1 from up) as ancestors, (select count(*) - 1 from down) as descendants"""),
    "lineage_all_counts": f"""
      with recursive {V2},
      reach as (select src as a, dst as b from lineage union select r.a, l.dst from reach r join lineage l on l.src = r.b),
      nodes as (select src as id from lineage union select dst from lineage),
      up as (select a as id, count(*) as n from reach where a <> b group by a),
      down as (select b as id, count(*) as n from reach where a <> b group by b)
      select id, coalesce(up.n, 0) as n_ancestors, coalesce(down.n, 0) as n_descendants
      from nodes left join up using (id) left join down using (id)""",
    "text_skips": v2("""
      select count(*) filter (where trim(coalesce(text, '')) = '') as skipped from (
        select definition as text from concepts union all select problem from papers)"""),
    "field_similarity": f"""
      with {CONTENTS},
      texts as (
        select {canon('name')} as key, definition as define, problem, task from parts where defines
        qualify row_number() over (partition by {canon('name')} order by pid desc) = 1
        union all select concat('paper:', pid), title, problem, task from parts where not defines),
      long as (
        select 'define' as field, key as id, define as text from texts
        union all select 'problem', key, problem from texts union all select 'task', key, task from texts),
      {embedded('long', 'field, id')},
      same as (select field, min(id) as id, vec, count(*) as n from vectors group by field, vec),
      sims as (
        select a.field, round(list_cosine_similarity(a.vec, b.vec), 3) + 0.0 as sim, a.n * b.n as n
        from same a join same b on a.field = b.field and a.id < b.id
        union all select field, 1.0, n * (n - 1) // 2 from same where n > 1),
      hist as (select field, sim, sum(n) as n from sims group by field, sim),
      upto as (select *, sum(n) over (partition by field order by sim) as upto, sum(n) over (partition by field) as total from hist)
      select field, cast(max(total) as bigint) as pairs, min(sim) as min_sim, round(sum(sim * n) / max(total), 6) as mean_sim,
             round((min(sim) filter (where upto >= (total + 1) // 2) + min(sim) filter (where upto >= total // 2 + 1)) / 2, 6) as median_sim,
             max(sim) as max_sim
      from upto group by field""",
    "node_vectors": v2(f"""
      , to_embed as (
        select concat('concept:', rk) as id, nullif(trim(definition), '') as text from concepts
        union all select concat('paper:', pid), nullif(trim(problem), '') from papers),
      {embedded("(select * from to_embed where text is not null)", "id")}
      select split_part(id, ':', 1) as type, count(*) as n, max(len(vec)) as dim,
             round(sum(list_dot_product(vec, vec)), 3) as norms, round(sum(vec[1]) + sum(vec[64]), 6) as ends
      from vectors group by 1"""),
    "node_vectors_v1": v1(f"""
      , texts as (
        select key as id, case when trim(definition) <> '' then concat(canonical, ': ', trim(definition))
               else concat(canonical, ' (', ptype, ')') end as text from v1_nodes),
      {embedded("texts", "id")}
      select count(*) as n, max(len(vec)) as dim, round(sum(vec[1]) + sum(vec[64]), 6) as ends from vectors"""),
    "vector_incremental": """
      with todo as (select doc_id as id from documents where trim(text) <> ''
                      and doc_id not in (select vec_id from embeddings where label < 7))
      select id, cast(floor((row_number() over (order by id) - 1) / 256) as bigint) as batch_no from todo""",
    "similarity_stats": f"""{SIMS}
      select 'problem' as field, count(*) as pairs, round(min(sim), 6) as min_sim, round(avg(sim), 6) as mean_sim,
             round(median(sim), 6) + 0.0 as median_sim, round(max(sim), 6) as max_sim from sims""",
    "similarity_top": f"""{SIMS}
      select concat('label ', la) as field, a, b, sim from sims join (select id, label as la from v) x on x.id = a
      where same qualify row_number() over (partition by la order by sim desc, a, b) <= 5""",
    "similarity_pairs": f"""{REP_SIMS.format(labels="true")}
      select * from rows where sim >= 0.3""",
    "similarity_family": f"""{REP_SIMS.format(labels="label % 5 in (0, 1, 3)")}
      select * from rows where sim >= 0.2""",
    "similarity_overlay": f"""{SIMS}
      , reps as (select id, min(id) over (partition by vec) as rep from v)
      select least(x.rep, y.rep) as source, greatest(x.rep, y.rep) as target, sim, count(*) as node_pairs
      from sims join reps x on a = x.id join reps y on b = y.id where sim >= 0.3 and not same group by all""",
    "vector_topk": f"""
      with {VEC}, scored as (select id, label, list_cosine_similarity(vec, qv) as score from v, q),
      ranked as (select *, cast(row_number() over (partition by label order by score desc, id) as integer) as rank
                 from scored where score >= 0.30)
      select label, rank, id, round(score, 6) as score from ranked where rank <= 8""",
    "vector_index_exact": """
      with v as (select vec_id as id, embedding::double[] as vec from embeddings),
      scored as (select a.id as qid, b.id, list_cosine_similarity(a.vec, b.vec) as score from v a join v b on a.id % 100 = 0),
      ranked as (select *, cast(row_number() over (partition by qid order by score desc, id) as integer) as rank from scored)
      select qid, rank, id, round(score, 6) as score from ranked where rank <= 8 and score >= 0.30""",
    "vector_index_recall": """
      with v as (select vec_id as id, embedding::double[] as vec from embeddings),
      scored as (select a.id as qid, b.id, list_cosine_similarity(a.vec, b.vec) as score from v a join v b on a.id % 100 = 0),
      ranked as (select *, row_number() over (partition by qid order by score desc, id) as rank from scored)
      select count(*) as n, true as enough from ranked where rank <= 8 and score >= 0.30""",
    "vector_cosine": f"with {VEC} select id, round(list_cosine_similarity(vec, qv), 3) + 0.0 as sim from v, q",
    "related_terms": f"""{HITS},
      terms as (
        select 0 as side, id, score, p_name as term from hits join part on p_partkey = id where not paper
        union all
        select 1, id, score, o_orderpriority from hits join orders on o_orderkey = id where paper)
      select side, id, term from terms where term <> '' order by side, score desc, id limit 10""",
    "status_lines": f"""{HITS}
      select id, case when p_type = 'PROMO' or p_size <= 25
               then concat('- ', p_name, ' (no definition yet) [', printf('%.2f', score), ']')
               else concat('- ', p_name, ': ', p_type, ' [', printf('%.2f', score), ']') end as line
      from hits join part on p_partkey = id where not paper
      union all
      select id, concat('- ', o_orderpriority, ' — ',
               case o_orderstatus when 'P' then '(no problem statement)' else o_orderstatus end,
               ' [', printf('%.2f', score), ']')
      from hits join orders on o_orderkey = id where paper""",
    "query_dedup": """
      with s as (
        select c_custkey as ord, trim(case when c_acctbal < 0 then '  ' when c_acctbal < 5000 then
                 concat(' ', lower(c_mktsegment), ' ') else concat(c_mktsegment, ' ', c_nationkey) end) as query
        from customer)
      select ord, query from s where query <> ''
      qualify row_number() over (partition by lower(query) order by ord) = 1""",
    "paper_search": f"""
      with {FEED}
      select aid, query_ord, rank, title, abstract, left(stamp, 10) as published, abstract as categories,
             query as first_seen_query
      from ranked where left(stamp, 7) between '2024-03' and '2025-06'
      qualify row_number() over (partition by aid order by query_ord, rank) = 1""",
    "search_page": f"""
      with {FEED} select query_ord, rank, entry_ord from ranked where rank <= 50""",
    "paper_months": f"""
      with {FEED}
      select aid, concat('20', aid[1:2], '-', aid[3:4]) as month, count(*) as n, min(left(stamp, 7)) as first_published
      from feed group by aid""",
    "candidate_funnel": f"""{FATE}
      select count(*) as found, count(*) filter (where fate = 'owned') as owned_excluded,
             count(*) filter (where fate = 'gate') as gate_excluded, count(*) filter (where fate = 'new') as new
      from fates""",
    "candidate_ids": f"{FATE} select aid, title from fates where fate = 'new'",
    "ledger_upsert": f"""with {FOUND}
      select coalesce(f.aid, l.aid) as aid, coalesce(f.title, 'old title') as title,
             coalesce(length(f.abstract), length('old abstract')) as abstract_chars,
             coalesce(f.published, '2020-01-01') as published, coalesce(f.categories, 'old') as categories,
             l.verdict, coalesce(l.extracted, false) as extracted,
             case when l.aid is not null then 'seed' else f.first_seen_query end as first_seen_query
      from found f full join ledger l on f.aid = l.aid""",
    "gate_verdicts": f"{GATE} select aid, verdict, verdict = 'technique' as passed, cached from gate where asked",
    "gate_ledger": f"""{GATE}
      select case when asked and not cached then verdict else old end as verdict,
             case when asked and not cached then 'keyword-rules' else 'human' end as model,
             case when asked and not cached then 'gate-v1' else old_ver end as prompt_ver,
             case when asked and not cached then '2024-06-01' else '2024-01-01' end as date,
             count(*) as n from gate group by all""",
    "gate_funnel": f"""{GATE}
      select count(*) as judged, count(*) filter (where verdict = 'technique') as passed,
             count(*) filter (where not cached) as calls, count(*) filter (where cached) as cache_hits
      from gate where asked""",
    "metadata_complete": f"""with {FOUND}
      select count(*) as n, count(*) filter (where abstract <> '' and published <> '') as complete,
             count(*) filter (where abstract <> '' and published <> '') * 2 >= count(*) as majority from found""",
    "url_ids": """
      select page_id, regexp_replace(regexp_extract(rtrim(url, '/'), '[^/]*$'), 'v[0-9]+$', '') as aid from pages""",
    "page_titles": """
      select page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title
      from pages""",
    "page_window": f"""with {LINE_PAGES}, {PAGE_SUMS.format(budget=20000)}
      select paper_id, count(*) as pages, cast(max(page) as integer) as last_page,
             cast(sum(length(text)) as bigint) as chars
      from kept group by paper_id""",
    "paper_texts": f"""with {LINE_PAGES}, {PAGE_SUMS.format(budget=20000)}
      select paper_id, md5(t) as digest from whole""",
    "text_cut": f"""with {TALK_PAGES}, 
      whole as (select paper_id, string_agg(text, '' order by page) as t from pages_of group by paper_id),
      {cut('whole', 'paper_id', 't', 'whole', 't')}
      select paper_id, true as ok, cut_method, length(text) as char_count, md5(text) as digest from done""",
    "document_cut": f"""with {cut('documents', 'doc_id', 'text')}
      select doc_id, cut_method, md5(text) as digest from done""",
    "workflow_trace": """
      with log as (
        select conv_id, turn, case role when 'user' then 'interpret' when 'assistant' then 'approve'
                 else 'extract_confirm' end as stage,
               case when length(text) > 600 then 'proceed' when length(text) > 300
                 then concat('revise: ', left(text, 10)) else 'cancel' end as decision
        from conversations)
      select conv_id, turn, stage,
             case when stage = 'interpret' then
                    case when decision like 'revise:%' then 'parse' when decision = 'cancel' then 'report'
                         else 'expand_search' end
                  when decision = 'proceed' then if(stage = 'approve', 'gate', 'extract')
                  else 'report' end as next,
             case when stage = 'interpret' then
                    if(decision like 'revise:%', 'parse', 'expand_search')
                  when decision = 'proceed' then if(stage = 'approve', 'gate', 'extract')
                  else 'report' end as next_strict,
             case when decision like 'revise:%' then trim(substr(decision, 8)) end as revised
      from log""",
}

ORACLES["ledger_upsert_stored"] = ORACLES["ledger_upsert"]
ORACLES["rebuild_counts_delta"] = ORACLES["rebuild_counts"]
ORACLES["graph_v1_nodes_delta"] = ORACLES["graph_v1_nodes"]
ORACLES["graph_v1_edges_delta"] = ORACLES["graph_v1_edges"]
ORACLES["lexicon_stored"] = ORACLES["lexicon_rows"]
ORACLES["lexicon_document"] = f"""{LEX_ONLY}
      select row_number() over (order by ord) - 1 as ord, name, concat(a1, '|', a2) as aliases, status, definition, source, first_seen from lex"""
ORACLES["ledger_document"] = ORACLES["ledger_upsert"]
ORACLES["graph_v1_document"] = ORACLES["graph_v1_edges"]
ORACLES["graph_v2_document"] = ORACLES["graph_v2_edges"]
