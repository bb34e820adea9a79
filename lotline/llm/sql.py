"""DuckDB SQL of the operators that SQL can say, written from their rules."""

from __future__ import annotations

from lotline.llm import mixing, part_codes, url_filter, vector_forest


def secret_scan_sql() -> str:
    """Counts, checksum and spans by the matches of each kind and what lies between them."""
    assign = r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [
        ("assign", assign, 2, 12, "i"),
        ("access", "AKIA[A-Z0-9]+", 0, 18, "c"),
        ("hex", "[0-9a-f]+", 0, 16, "c"),
        ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, "c"),
        ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, "c"),
        ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, "c"),
    ]
    scans = " union all ".join(
        f"""select row, '{kind}' kind, {rank} rank, {least} least, string_split_regex(t, '{p}', '{flag}') gaps,
                   regexp_extract_all(t, '{p}', 0, '{flag}') whole, regexp_extract_all(t, '{p}', {group}, '{flag}') part
            from d"""
        for rank, (kind, p, group, least, flag) in enumerate(kinds)
    )
    return f"""
    with d as (select doc_id, coalesce(text, '') t, row_number() over () as row from documents),
    scans as ({scans}),
    matches as (
        select row, kind, rank, least, unnest(range(1, len(whole) + 1)) i, unnest(gaps) gap, unnest(whole) hit, unnest(part) told
        from scans),
    placed as (
        select row, kind, rank, length(told) >= least ok, length(hit) size,
               sum(length(gap) + length(hit)) over (partition by row, kind order by i) as stop
        from matches where hit is not null),
    found as (
        select row, kind, rank, stop - size as start, kind || ':' || cast(stop - size as bigint) || ':' || cast(stop as bigint) span
        from placed where ok),
    told as (
        select row, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access,
               count(*) filter (kind = 'hex') n_hex,
               string_agg(span, ',' order by start, rank) filter (rank < 3) base,
               string_agg(span, ',' order by start, rank) spans
        from found group by row)
    select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
           sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
    from d left join told using (row)"""


def mixing_sql(weights: dict[str, int]) -> str:
    """Places by a plain numbering of each source."""
    slots = sum(weights.values())
    plan = ", ".join(f"('{name}', {weights[name]}, {turn}, {at})" for name, turn, at in mixing.period(weights))
    named = ", ".join(f"'{name}'" for name in weights if name != mixing.REST)
    return f"""
    with plan(share, weight, turn, turn_slot) as (values {plan}),
    d as (select doc_id, source, case when source in ({named}) then source else '{mixing.REST}' end share from documents),
    numbered as (
        select *, row_number() over (
            partition by share order by md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 as number
        from d),
    blocks as (select *, number // {mixing.BLOCK_DOCS} as block, number % {mixing.BLOCK_DOCS} as place from numbered)
    select doc_id, source, blocks.share, block, block * {slots} // weight as release,
           ((block + 1) * {slots} + weight - 1) // weight as deadline, block // weight * {slots} + turn_slot as slot, place
    from blocks join plan on plan.share = blocks.share and turn = block % weight"""


def url_filter_sql() -> str:
    """Hosts, paths, rules and the two character models."""
    order, prior = url_filter.ORDER, url_filter.PRIOR
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in url_filter.RULES)
    models = []
    for k in range(1, order + 2):
        models.append(f"c{k} as (select right(gram, {k}) g, sum(a) a, sum(b) b from grams group by 1)")
        if k == 1:
            models.append(
                f"""p1 as (
                select g, (a + {prior} / 256) / (sum(a) over () + {prior}) pa, (b + {prior} / 256) / (sum(b) over () + {prior}) pb
                from c1)"""
            )
        else:
            models.append(
                f"""p{k} as (
                select g, (a + {prior} * pa) / (sum(a) over w + {prior}) pa, (b + {prior} * pb) / (sum(b) over w + {prior}) pb
                from (select c{k}.g, a, b, pa, pb from c{k} join p{k - 1} s on s.g = right(c{k}.g, {k - 1}))
                window w as (partition by left(g, {k - 1})))"""
            )
    return f"""
    with rules(rhost, rpath, act) as (values {rules}),
    u as (
        select row_number() over () as row, page_id, coalesce(url, '') url,
               case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest
        from pages),
    parts as (
        select row, page_id, url, regexp_extract(rest, '^([^/?#]*)', 1) given, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path
        from u),
    hosts as (
        select row, page_id, url, path,
               translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host
        from parts),
    ruled as (
        select hosts.*, rhost || rpath as rule, act, row_number() over (partition by row order by length(rhost || rpath) desc) best
        from hosts left join rules
            on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)),
    judged as (
        select *, act is not null and substr(md5(url), 1, 1) < '3' as tells from ruled where best = 1),
    positions as (
        select row, act, tells,
               substr(repeat(chr(2), {order}) || url || chr(3), i, {order + 1}) gram
        from (select *, unnest(range(1, length(url) + 2)) i from judged)),
    grams as (
        select gram, count(*) filter (act = 'allow' and not tells) a, count(*) filter (act = 'block' and not tells) b
        from positions group by gram),
    {", ".join(models)},
    scores as (
        select row, any_value(act) act, avg(ln(pa) - ln(pb)) x
        from positions join p{order + 1} on g = gram where act is null or tells group by row),
    sides as (
        select count(*) filter (act = 'allow') na, count(*) filter (act = 'block') nb,
               avg(x) filter (act = 'allow') a, avg(x) filter (act = 'block') b,
               sum(x * x) filter (act = 'allow') xa, sum(x * x) filter (act = 'block') xb
        from scores),
    calibrated as (
        select coalesce(case when a > b then (a + b) / 2 end, 0) middle,
               coalesce(case when a > b then (a - b) / ((xa + xb - na * a * a - nb * b * b) / (na + nb)) end, 1) slope
        from sides),
    odds as (select row, round((x - middle) * slope, 6) log_odds from scores, calibrated where act is null)
    select page_id, host, path, rule, coalesce(act, case when log_odds >= 0 then 'allow' else 'block' end) verdict, log_odds
    from judged left join odds using (row)"""


def part_codes_sql() -> str:
    """Codebooks round by round, with plain squared differences of all parts and entries."""
    parts, entries, rounds = part_codes.PARTS, part_codes.ENTRIES, part_codes.ROUNDS
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""d{i} as materialized (
        select row, p, min(struct_pack(d := d, e := e)) best from (
            select c.row, c.p, b.e, sum((c.x - b.x) * (c.x - b.x)) d from comps c join b{i} b using (p, j) group by all)
        group by all)"""
        )
        if i < rounds:
            steps.append(
                f"""b{i + 1} as materialized (
        select p, e, j, coalesce(m.x, b.x) x from b{i} b left join (
            select p, best.e e, j, cast((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) as bigint) x
            from d{i} join comps using (row, p) group by all) m using (p, e, j))"""
            )
    return f"""
    with v as materialized (
        select row_number() over (order by vec_id nulls last, embedding) row, vec_id, label,
               [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] c
        from embeddings
        where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    size as (select greatest(1, cast(ceil(max(len(c)) / {parts}) as bigint)) m from v),
    comps as materialized (
        select row, cast((i - 1) // m as int) p, cast((i - 1) % m as int) j, coalesce(c[i], 0) x
        from (select row, c, m, unnest(range(1, cast({parts} * m as bigint) + 1)) i from v, size)),
    b0 as materialized (select p, cast(row - 1 as int) e, j, x from comps where row <= {entries}),
    {", ".join(steps)},
    told as (
        select row, string_agg(printf('%02x', best.e), '' order by p) code, cast(sum(best.d) as bigint) error
        from d{rounds} group by row),
    books as (select sha256(coalesce(string_agg(cast(x as varchar), ',' order by p, e, j), '')) h from b{rounds})
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, h codebooks_sha256
    from v join told using (row), books"""


def vector_links_sql() -> str:
    """Links by comparing all pairs of a label, components by their closure."""
    return f"""
    with recursive v as materialized (
        select row_number() over () as row, vec_id, label, cast(embedding as double[]) e from embeddings),
    usable as materialized (
        select * from v
        where label is not null and e is not null and len([x for x in e if x is null or not isfinite(x)]) = 0
              and len([x for x in e if x <> 0]) > 0),
    links as materialized (
        select a.row a, b.row b from usable a join usable b on a.label = b.label and len(a.e) = len(b.e) and a.row <> b.row
        where list_cosine_similarity(a.e, b.e) >= {vector_forest.COSINE}),
    reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on l.a = r.b),
    firsts as (select a, min(vec_id) first_id from reached join v on v.row = b group by a),
    counts as (select a, count(*) n from links group by a)
    select vec_id, coalesce(n, 0) n_links, coalesce(least(vec_id, first_id), vec_id) component_id,
           vec_id is not distinct from coalesce(least(vec_id, first_id), vec_id) kept
    from v left join counts on counts.a = row left join firsts on firsts.a = row"""
