"""Reference SQL (DuckDB dialect) for the queries of the catalog, written independently of Spark."""

from __future__ import annotations

import math

from sievework.functions.stem import (
    ABOVE_ONE, DOUBLE_END, EXACTLY_ONE, HAS_VOWEL, IRREGULAR, POSITIVE, SHORT_END, STEP_2, STEP_3, STEP_4,
)
from sievework.functions.text import CLOUD_PATTERN, ENGLISH_STOP_WORDS, WORD_PATTERN
from sievework.operators.lemmas import DETACHMENTS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def hashed(seed: int, key: str) -> str:
    return f"('0x' || left(md5(concat_ws('|', '{seed}', {key})), 15))::bigint"


NOT_ASCII = r"'[^\x00-\x7F]'"
STOP_WORDS = in_list(ENGLISH_STOP_WORDS)

SIZED = "select p_partkey, case when p_size not in (1, 2, 3) then p_size end as p_size from part"


def fill(value: str) -> str:
    return f"""
        with s as ({SIZED})
        select p_partkey, round(coalesce(p_size::double, ({value})), 6) + 0.0 as p_size from s
    """


def frequency_bins(table: str, column: str, bins: int) -> str:
    """CTEs ending in ``binned (all columns, x, bin)`` for equal-frequency bins."""
    return f"""
        with recursive src as (select *, {column} as x from {table}),
        total as (select count(x) as n from src),
        steps(left_bins, taken, remaining) as (
            select {bins}, 0::bigint, n from total
            union all
            select left_bins - 1,
                   taken + round_even(remaining / left_bins::double, 0)::bigint,
                   remaining - round_even(remaining / left_bins::double, 0)::bigint
            from steps where left_bins > 1
        ),
        ordered as (select x, row_number() over (order by x) - 1 as r from src where x is not null),
        cuts as (
            select x as cut from steps join ordered on r = least(taken, (select n - 1 from total))
            where left_bins < {bins}
        ),
        cut_list as (select list(cut) as cuts from cuts),
        binned as (
            select src.*, len(list_filter(cuts, lambda c: src.x >= c)) as bin from src, cut_list
        )
    """


def width_bins(table: str, column: str, bins: int) -> str:
    """CTEs ending in ``binned (all columns, x, bin)`` for equal-width bins."""
    bounds = " + ".join(f"(x >= low + {i} * ((high - low) / {bins}))::int" for i in range(1, bins))
    return f"""
        with src as (select *, {column} as x from {table}),
        ends as (select min(x) as low, max(x) as high from src),
        binned as (select src.*, {bounds} as bin from src, ends)
    """


def line_bins(aggregate: str) -> str:
    return frequency_bins("lineitem", "l_extendedprice", 7) + f"""
        , reps as (select bin, {aggregate}(x) as rep from binned group by bin)
        select l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(rep, 4) + 0.0 as price
        from binned join reps using (bin)
    """


def order_bins(aggregate: str) -> str:
    return width_bins("orders", "o_totalprice", 7) + f"""
        , reps as (select bin, {aggregate}(x) as rep from binned group by bin)
        select o_orderkey, round(rep, 6) + 0.0 as o_totalprice from binned join reps using (bin)
    """


NAMES = "['lowest', 'low', 'middle', 'high', 'highest']"

ASCII_DOCS = f"select * from documents where not regexp_matches(text, {NOT_ASCII})"
COUNTS = f"""
    words as (
        select doc_id as id, unnest(regexp_extract_all(lower(text), {quoted(WORD_PATTERN)})) as term
        from ({ASCII_DOCS})
    ),
    counts as (
        select id, term, count(*) as cnt from words where term not in {STOP_WORDS} group by id, term
    )
"""


def _longest(rules, measure: str) -> str:
    cases = []
    for suffix, replacement in sorted(rules, key=lambda rule: -len(rule[0])):
        stem = f"left(w, length(w) - {len(suffix)})"
        test = f"regexp_matches({stem}, {quoted(measure)})"
        if suffix == "ion":
            test += f" and regexp_matches({stem}, '[st]$')"
        cases.append(
            f"when ends_with(w, '{suffix}') then case when {test} then concat({stem}, '{replacement}') else w end"
        )
    return "case " + " ".join(cases) + " else w end"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _matches(n: int, pattern: str) -> str:
    return f"regexp_matches({_cut(n)}, {quoted(pattern)})"


STEM_STEPS = (
    f"""case when ends_with(w, 'ies') and length(w) = 4 then {_cut(1)}
        when ends_with(w, 'sses') or ends_with(w, 'ies') then {_cut(2)}
        when ends_with(w, 'ss') then w when ends_with(w, 's') then {_cut(1)} else w end""",
    f"""case when ends_with(w, 'ied') then case when length(w) = 4 then {_cut(1)} else {_cut(2)} end
        when ends_with(w, 'eed') then case when {_matches(3, POSITIVE)} then {_cut(1)} else w end
        when ends_with(w, 'ed') and {_matches(2, HAS_VOWEL)} then concat({_cut(2)}, '+')
        when ends_with(w, 'ing') and {_matches(3, HAS_VOWEL)} then concat({_cut(3)}, '+') else w end""",
    f"""case when not ends_with(w, '+') then w
        when {_matches(1, '(?:at|bl|iz)$')} then concat({_cut(1)}, 'e')
        when {_matches(1, DOUBLE_END)} then {_cut(2)}
        when {_matches(1, EXACTLY_ONE)} and {_matches(1, SHORT_END)} then concat({_cut(1)}, 'e') else {_cut(1)} end""",
    f"case when regexp_matches(w, '^.+[^aeiouy]y$') then concat({_cut(1)}, 'i') else w end",
    f"case when ends_with(w, 'alli') and {_matches(4, POSITIVE)} then {_cut(2)} else w end",
    f"""case when ends_with(w, 'logi') then case when {_matches(3, POSITIVE)} then {_cut(1)} else w end
        else {_longest(STEP_2, POSITIVE)} end""",
    _longest(STEP_3, POSITIVE),
    _longest([(s, "") for s in STEP_4], ABOVE_ONE),
    f"""case when ends_with(w, 'e') and ({_matches(1, ABOVE_ONE)}
        or ({_matches(1, EXACTLY_ONE)} and not {_matches(1, SHORT_END)})) then {_cut(1)} else w end""",
    f"case when ends_with(w, 'll') and {_matches(1, ABOVE_ONE)} then {_cut(1)} else w end",
)


def stems(vocabulary: str) -> str:
    """CTEs ending in ``stems (term, stem)`` for the distinct terms of a CTE."""
    marked = "regexp_replace(regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    parts = [f"s0 as (select distinct term, {marked} as w from {vocabulary})"]
    for i, step in enumerate(STEM_STEPS, 1):
        parts.append(f"s{i} as materialized (select term, {step} as w from s{i - 1})")
    own = " ".join(f"when term = {quoted(t)} then {quoted(s)}" for t, s in IRREGULAR.items())
    last = len(STEM_STEPS)
    parts.append(
        f"stems as (select term, case when length(term) <= 2 then term {own} else lower(w) end as stem from s{last})"
    )
    return ", ".join(parts)


def lemmatised(part: str) -> str:
    """Counts by dictionary form, every form of every word tried."""
    forms = ", ".join(
        f"case when suffix(form, '{old}') then left(form, length(form) - {len(old)}) || '{new}' end"
        for old, new in DETACHMENTS[part]
    )
    return f"""
        with recursive {COUNTS},
        vocabulary as (select distinct term from counts),
        dictionary as (select term as form from counts group by term having count(*) > 1),
        shorter(term, round, form) as (
            select term, 0, term from vocabulary where not suffix(term, 'en')
            union all
            select term, round + 1, new from (
                select term, round, unnest([{forms}]) as new from shorter where round < 3)
            where new is not null
        ),
        tried as (
            select term, greatest(round, 1) as round, form from shorter
            union all
            select term, 0, unnest([term, left(term, length(term) - 2)]) from vocabulary where suffix(term, 'en')
        ),
        ranked as (
            select term, form, row_number() over (
                partition by term order by round, length(form), (form <> term)::int, form) as place
            from tried where form in (select form from dictionary)
        )
        select id, coalesce(form, c.term) as term, sum(cnt)::bigint as cnt
        from counts c left join ranked r on r.term = c.term and place = 1
        group by all
    """


def information(labels: str) -> str:
    """CTEs ending in ``scores (term, mi)`` by brute force over every count, 0 included."""
    return f"""
        labels_of as ({labels}),
        total as (select count(*)::double as n from labels_of),
        cells as (
            select term, cnt, label, count(*)::double as n
            from counts join labels_of using (id) group by term, cnt, label
        ),
        class_n as (select label, count(*)::double as n from labels_of group by label),
        present as (select term, label, sum(n) as n from cells group by term, label),
        zeros as (
            select t.term, 0 as cnt, c.label, c.n - coalesce(p.n, 0) as n
            from (select distinct term from cells) t, class_n c
            left join present p on p.term = t.term and p.label = c.label
        ),
        joint as (select * from cells union all select * from zeros where n > 0),
        margin as (select term, cnt, sum(n) as n from joint group by term, cnt),
        scores as (
            select j.term, greatest(sum(j.n / total.n * ln(j.n * total.n / (m.n * c.n))), 0.0) as mi
            from joint j join margin m on m.term = j.term and m.cnt = j.cnt join class_n c on c.label = j.label, total
            group by j.term
        )
    """


def psi(n: str) -> str:
    """The digamma function of a whole number from 1."""
    sums = ", ".join(repr(-0.5772156649015329 + sum(1 / i for i in range(1, k))) + "::double" for k in range(1, 20))
    x = f"(1.0::double / ({n}))"
    return f"""(case when ({n}) < 20 then [{sums}][({n})::int]
        else ln(({n})::double) - {x} / 2 - {x} ** 2 / 12 + {x} ** 4 / 120 - {x} ** 6 / 252 + {x} ** 8 / 240 end)"""


def root_split(impurity: str) -> str:
    """The best first split of the counts of ``kept`` by 0/1 labels, over every cut of every term."""
    def side(ones: str, both: str) -> str:
        if impurity == "gini":
            return f"(({ones}) ** 2 + ({both} - ({ones})) ** 2) / {both}"
        part = lambda n: f"(case when {n} > 0 then {n} * log2(greatest({n}, 1)) else 0 end)"
        return f"({part(f'({ones})')} + {part(f'({both} - ({ones}))')} - {part(both)})"

    return f"""
        select '{impurity}' as impurity, term, (low + cnt) / 2.0::double as threshold, below
        from cuts, whole
        where below > 0 and below < n
        order by round(({side("ones", "below::double")} + {side("whole.p - ones", "(n - below)::double")}) / n, 9) desc, term, threshold
        limit 1
    """


def nearest(labels: str) -> str:
    """CTEs ending in ``scores (term, mi)``: every cell against every cell of its term, count 0 included."""
    return f"""
        all_labels as ({labels}),
        class_n as (select label, count(*) as size from all_labels group by label having count(*) > 1),
        cells as (
            select term, cnt, label, count(*) as n from counts join all_labels using (id) join class_n using (label)
            group by term, cnt, label
        ),
        zeros as (
            select term, 0 as cnt, c.label, c.size - coalesce(sum(n), 0) as n
            from (select distinct term from cells) t cross join class_n c left join cells p using (term, label)
            group by term, c.label, c.size
        ),
        joint as (
            select term, cnt, label, n, size
            from (select term, cnt, label, n from cells union all select term, cnt, label, n from zeros where n > 0) join class_n using (label)
        ),
        apart as (
            select j.term, j.label, j.cnt, j.n, j.size, abs(j.cnt - u.cnt) as d,
                   sum(u.n) over (partition by j.term, j.label, j.cnt order by abs(j.cnt - u.cnt)) - 1 as k
            from joint j join joint u on u.term = j.term and u.label = j.label
        ),
        reach as (
            select term, label, cnt, n, min(d) as radius, min(k) as k from apart where k >= least(3, size - 1) group by all
        ),
        around as (
            select r.term, r.label, r.cnt, r.n, r.k, sum(u.n) - 1 as m
            from reach r join joint u on u.term = r.term and abs(u.cnt - r.cnt) <= radius group by all
        ),
        total as (select sum(size) as n, sum(size * {psi("size")}) as part from class_n),
        scores as (
            select term, greatest({psi("any_value(total.n)")} + (sum(a.n * ({psi("k")} - {psi("m")})) - any_value(part)) / any_value(total.n), 0.0) as mi
            from around a, total group by term
        )
    """


#: Where the number of a Poisson draw of mean 1 grows by one, in steps of 2 ** -30.
POISSON_STEPS = [math.floor(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * (1 << 30)) for k in range(13)]

SPLIT_LABELS = f"""
    hashed as (select doc_id as id, source as label, {hashed(42, 'doc_id')} as h from ({ASCII_DOCS})),
    split as (
        select id, label, row_number() over (order by h) <= ceil(0.2 * (select count(*) from hashed)) as is_test
        from hashed
    )
"""
NB = f"""
    with {COUNTS}, {SPLIT_LABELS},
    train as (select id, label from split where not is_test),
    test as (select id, label from split where is_test),
    pairs as (select term, label, sum(cnt) as n from counts join train using (id) group by term, label),
    vocab as (select distinct term from pairs),
    totals as (select label, sum(n) as total from pairs group by label),
    classes as (
        select label, ln(count(*) / (select count(*) from train)) as log_prior from train group by label
    ),
    terms as (
        select t.id, c.label, k.cnt, k.term from test t join counts k using (id) join vocab using (term), classes c
    ),
    liked as (
        select t.id, t.label, sum(t.cnt * ln((coalesce(p.n, 0) + 1)
            / (coalesce(s.total, 0) + (select count(*) from vocab)))) as part
        from terms t left join pairs p on p.term = t.term and p.label = t.label
        left join totals s on s.label = t.label
        group by t.id, t.label
    ),
    scored as (
        select t.id, t.label as truth, c.label, c.log_prior + coalesce(l.part, 0) as score
        from test t cross join classes c left join liked l on l.id = t.id and l.label = c.label
    ),
    predicted as (
        select id, truth as label, label as prediction, score from scored
        qualify row_number() over (partition by id order by score desc, label) = 1
    )
"""
CLASS_SCORES = """
    , classes_of as (select label as class from predicted union select prediction from predicted),
    sums as (
        select class, count(*) filter (label = class) as support, count(*) filter (prediction = class) as predicted_n,
            count(*) filter (label = class and prediction = class) as hits
        from classes_of join predicted on label = class or prediction = class group by class
    ),
    per_class as (
        select class, support,
            case when predicted_n > 0 then hits / predicted_n::double else 0.0 end as precision,
            case when support > 0 then hits / support::double else 0.0 end as recall,
            2 * hits / (support + predicted_n)::double as f1
        from sums
    )
"""
FEATURES = """concat('{"', p_name, '","', p_brand, chr(92), '","', p_type, '","last"}')"""


def label(column: str) -> str:
    return f"trim(concat('_', {column}))"


def mean_of(column: str, source: str) -> str:
    return f"(select avg({column}) from {source})"


def density() -> str:
    return """
        with s as (
            select count(o_totalprice) as n, stddev_samp(o_totalprice) as sd,
                min(o_totalprice) as low, max(o_totalprice) as high from orders
        ),
        b as (select *, sd * power(n, -0.2) as h from s),
        grid as (
            select low - 3 * h + i * ((high - low + 6 * h) / 199) as x, h, n from b, range(200) as r(i)
        )
        select round(x, 4) as x, round(sum(exp(-0.5 * power((o_totalprice - x) / h, 2))) / (n * h * sqrt(2 * pi())), 14)
            as density
        from grid, orders group by x, h, n
    """


PREPARED = """
    with recursive typed as (
        select l_partkey, l_linenumber, l_orderkey::varchar as l_orderkey,
            case when l_quantity not in (1, 2) then l_quantity end as l_quantity,
            case when l_discount <> 0 then l_discount end as l_discount,
            l_tax, l_extendedprice as price,
            case when l_returnflag <> 'R' then l_returnflag end as l_returnflag, l_linestatus
        from lineitem
    ),
    cleaned as (
        select * replace (
            coalesce(l_quantity::double, (select avg(l_quantity) from typed)) as l_quantity,
            coalesce(l_discount, 0) as l_discount
        )
        from typed where l_returnflag is not null
    ),
    ordered as (select price, row_number() over (order by price) - 1 as r from cleaned),
    steps(left_bins, taken, remaining) as (
        select 7, 0::bigint, count(*) from cleaned
        union all
        select left_bins - 1, taken + round_even(remaining / left_bins::double, 0)::bigint,
            remaining - round_even(remaining / left_bins::double, 0)::bigint
        from steps where left_bins > 1
    ),
    cut_list as (select list(price) as cuts from steps join ordered on r = taken where left_bins < 7),
    binned as (select cleaned.*, len(list_filter(cuts, lambda c: cleaned.price >= c)) as bin from cleaned, cut_list),
    reps as (select bin, avg(price) as rep from binned group by bin),
    stats as (
        select avg(l_quantity) as mu, stddev_samp(l_quantity) as sd, min(l_tax) as low, max(l_tax) as high from cleaned
    ),
    top as (
        select l_linestatus as kept from cleaned group by l_linestatus order by count(*) desc, l_linestatus limit 1
    )
    select l_partkey, l_linenumber, l_orderkey,
        round((l_quantity - mu) / sd, 5) + 0.0 as l_quantity,
        round(l_discount::double, 5) + 0.0 as l_discount,
        round((l_tax - low) / (high - low), 5) + 0.0 as l_tax,
        round(rep, 3) + 0.0 as price, l_returnflag,
        case when l_linestatus in (select kept from top) then l_linestatus else 'OTHER' end as l_linestatus
    from binned join reps using (bin), stats
"""


def oracle_sql() -> dict[str, str]:
    stemmed = f"""
        with {COUNTS}, {stems('counts')}
        select id, stem as term, sum(cnt)::bigint as cnt from counts join stems using (term) group by id, stem
    """
    quality = "select doc_id as id, quality as label from labels where doc_id in (select doc_id from documents where not regexp_matches(text, " + NOT_ASCII + "))"
    return {
        "blank_sentinels": SIZED,
        "fill_value": fill("0"),
        "fill_mean": fill("select avg(p_size) from s"),
        "fill_median": fill("select median(p_size) from s"),
        "fill_mode": """
            with s as (select event_id, nullif(event_type, 'error') as t from events)
            select event_id, coalesce(t, (
                select t from s where t is not null group by t order by count(*) desc, t limit 1)) as event_type
            from s
        """,
        "drop_missing": "select event_id, event_type from events where nullif(event_type, 'error') is not null",
        "not_equal_keep_null": """
            select p_partkey, nullif(p_type, 'ECONOMY') as p_type from part
            where nullif(p_type, 'ECONOMY') is distinct from 'STANDARD'
        """,
        "equal_filter": "select doc_id, source from documents where lang = 'en'",
        "range_filter": "select o_orderkey, o_totalprice from orders where o_totalprice > 250000",
        "quantile_filter": """
            select o_orderkey, o_totalprice from orders
            where o_totalprice > (select quantile_cont(o_totalprice, 0.6) from orders)
        """,
        "dedup_keep_first": """
            select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem
            qualify row_number() over (
                partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1
        """,
        "rename_columns": "select c_custkey as id, c_mktsegment as segment from customer",
        "declared_types": """
            select p_partkey::double as p_partkey, p_size::varchar as p_size, p_retailprice from part
        """,
        "year_repair": """
            select p_partkey, case when p_size between 1 and 24 then p_size + 2000 else p_size end as p_size from part
        """,
        "nonnull_count": """
            select p_partkey, (p_size not in (1, 2, 3))::int + (p_type <> 'ECONOMY')::int
                + (p_brand not in ('Brand#1', 'Brand#2'))::int as present
            from part
        """,
        "split_columns": """
            with s as (select p_partkey, string_split(p_name, ' ') as a from part)
            select p_partkey, a[1] as word_1, a[2] as word_2, a[3] as word_3 from s
        """,
        "quoted_tokens": f"""
            with s as (
                select p_partkey, regexp_extract_all(replace({FEATURES}, chr(92), ''), '"(.*?)"', 1) as a from part
            )
            select p_partkey, a[1] as token_1, a[2] as token_2, a[3] as token_3 from s
        """,
        "books_shape": """
            with s as (select p_partkey as id, p_brand as publisher, string_split(p_name, ' ') as a from part)
            select id, publisher, a[1] as author_1, a[2] as author_2,
                (a[1] is not null)::int + (a[2] is not null)::int as total_authors
            from s
        """,
        "movies_shape": """
            with raw as (
                select l_orderkey as id, l_linenumber as line,
                    case when l_linestatus = 'O' then 'Untitled'
                        when l_linenumber > 2 then concat('T', l_linenumber) end as title,
                    case l_returnflag when 'R' then 'Canceled' when 'A' then 'Released' end as status,
                    array_to_string(range(1, l_linenumber + 1), ',') as keywords,
                    concat(l_returnflag, ', ', l_linestatus) as genres,
                    case when l_linenumber > 1 then concat_ws(',', l_suppkey, l_partkey, l_linenumber) end as companies,
                    l_linenumber::varchar as country, l_partkey, l_suppkey, l_quantity, l_extendedprice
                from lineitem
            ),
            one as (
                select * from raw qualify row_number() over (
                    partition by id order by line, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                        title nulls first, status nulls first) = 1
            ),
            s as (
                select *, string_split(keywords, ',') as k, string_split(genres, ',') as g,
                    string_split(companies, ',') as c
                from one where title is distinct from 'Untitled' and status is distinct from 'Canceled'
            )
            select id, title, status, line,
                k[1] as keyword_1, k[2] as keyword_2, k[3] as keyword_3, k[4] as keyword_4,
                least(len(k), 4)::int as total_keywords,
                g[1] as genre_1, g[2] as genre_2, g[3] as genre_3, g[4] as genre_4, least(len(g), 4)::int as total_genre,
                c[1] as production_company_1, c[2] as production_company_2, c[3] as production_company_3,
                c[4] as production_company_4, case when c is null then 0 else least(len(c), 4) end::int as total_production_company,
                country as production_country_1, country as production_country_2, country as production_country_3,
                3 as total_production_country
            from s
        """,
        "music_shape": f"""
            with raw as (
                select p_partkey as id, p_retailprice as views, case when p_size > 30 then p_size + 1830 else p_size end
                    as year, regexp_extract_all(replace({FEATURES}, chr(92), ''), '"(.*?)"', 1) as a
                from part
            ),
            fixed as (
                select * replace (case when year between 1 and 24 then year + 2000 else year end as year)
                from raw where views > (select quantile_cont(views, 0.6) from raw)
            )
            select id, views, year, a[1] as feature_1, a[2] as feature_2, a[3] as feature_3, 3 as total_features
            from fixed where year > 1850
        """,
        "z_score": """
            select c_custkey, round((c_acctbal - (select avg(c_acctbal) from customer))
                / (select stddev_samp(c_acctbal) from customer), 6) + 0.0 as c_acctbal
            from customer
        """,
        "min_max": """
            with s as (select min(p_retailprice) as low, max(p_retailprice) as high from part)
            select p_partkey, round((p_retailprice - low) / (high - low), 6) + 0.0 as p_retailprice from part, s
        """,
        "bins_freq_mean": line_bins("avg"),
        "bins_freq_median": line_bins("median"),
        "bins_freq_min": line_bins("min"),
        "bins_freq_max": line_bins("max"),
        "bins_freq_named": frequency_bins("lineitem", "l_extendedprice", 5) + f"""
            select l_orderkey, l_linenumber, l_partkey, l_extendedprice, ({NAMES})[bin + 1] as price from binned
        """,
        "bins_width_mean": order_bins("avg"),
        "bins_width_median": order_bins("median"),
        "bins_width_min": order_bins("min"),
        "bins_width_max": order_bins("max"),
        "bins_width_named": width_bins("orders", "o_totalprice", 5) + f"""
            select o_orderkey, ({NAMES})[bin + 1] as o_totalprice from binned
        """,
        "bins_freq_ties": frequency_bins("part", "p_size", 6) + """
            , reps as (select bin, avg(x) as rep from binned group by bin)
            select p_partkey, round(rep, 6) + 0.0 as p_size from binned join reps using (bin)
        """,
        "merge_uncommon_topk": """
            with kept as (select p_brand from part group by p_brand order by count(*) desc, p_brand limit 5)
            select p_partkey, case when p_brand in (from kept) then p_brand else 'OTHER' end as p_brand from part
        """,
        "merge_uncommon_count": """
            with kept as (select event_type from events group by event_type having count(*) >= 2000)
            select event_id, case when event_type in (from kept) then event_type else 'RARE' end as event_type
            from events
        """,
        "merge_uncommon_pct": """
            with kept as (
                select p_brand from part group by p_brand having count(*) >= 0.04::double * (select count(*) from part)
            )
            select p_partkey, case when p_brand in (from kept) then p_brand else 'RARE' end as p_brand from part
        """,
        "lang_metadata": "select doc_id, source, n_chars from documents where lang = 'en'",
        "lang_text": "select doc_id, md5(text) as digest from documents where lang = 'en'",
        "lang_split_semi_join": """
            select * from labels l where exists (
                select 1 from documents d where d.doc_id = l.doc_id and d.lang = 'en')
        """,
        "csv_ingest": "select doc_id, n_chars, md5(text) as digest from documents where lang = 'en'",
        "csv_ranges_ingest": "select doc_id, source, n_chars, md5(text) as digest from documents",
        "incremental_ingest": "select doc_id, n_chars, md5(text) as digest from documents where lang = 'en'",
        "ingest_music": """
            select doc_id as id, source as title, 1999::bigint as year, n_chars as views, md5(text) as digest
            from documents where lang = 'en'""",
        "ingest_movies": """
            select doc_id as id, source as title, n_chars as vote_count, 2.5::double as popularity, md5(text) as digest
            from documents where lang = 'en'""",
        "union_chunks": "select doc_id, lang, n_chars from documents",
        "ascii_filter": f"select doc_id, true as ascii from ({ASCII_DOCS})",
        "term_counts": f"with {COUNTS} select * from counts",
        "stem_vocabulary": f"with {COUNTS}, {stems('counts')} select * from stems",
        "stemmed_counts": stemmed,
        "lemmatised_nouns": lemmatised("noun"),
        "lemmatised_verbs": lemmatised("verb"),
        "lemma_counts": f"""
            with {COUNTS}
            select id, case when ends_with(term, 's') then left(term, length(term) - 1) else term end as term,
                sum(cnt)::bigint as cnt
            from counts group by all
        """,
        "term_totals": f"with {COUNTS} select term, sum(cnt)::bigint as total from counts group by term",
        "rare_term_prune": f"""
            with {COUNTS}
            select * from counts where term in (select term from counts group by term having sum(cnt) >= 15)
        """,
        "bag_join_label": f"""
            with {COUNTS}
            select id, term, cnt, quality as "quality_GENRE" from counts join labels on id = doc_id
        """,
        "source_information": f"""
            with {COUNTS}, {information(f"select doc_id as id, source as label from ({ASCII_DOCS})")}
            select term, round(mi, 8) + 0.0 as mi from scores
        """,
        "mutual_information_topk": f"""
            with {COUNTS}, {information(quality)}
            select term, round(mi, 8) + 0.0 as mi from (
                select * from scores order by round(mi, 12) desc, term limit 200)
        """,
        "tree_root_splits": f"""
            with {COUNTS}, labels_of as (select * from ({quality}) where label is not null),
            whole as (select count(*) as n, sum(label)::double as p from labels_of),
            kept as (select term, cnt, count(*) as n, sum(label) as p from counts join labels_of using (id) group by term, cnt),
            sides as (
                select term, cnt, coalesce(lag(cnt) over up, 0) as low, sum(n) over (partition by term) as held,
                    sum(p) over (partition by term) as held_p,
                    coalesce(sum(n) over (up rows between unbounded preceding and 1 preceding), 0) as under,
                    coalesce(sum(p) over (up rows between unbounded preceding and 1 preceding), 0) as under_p
                from kept window up as (partition by term order by cnt)
            ),
            cuts as (
                select term, cnt, low, (whole.n - held + under)::bigint as below, (whole.p - held_p + under_p)::double as ones
                from sides, whole
            )
            select * from ({root_split("gini")}) union all select * from ({root_split("entropy")})
        """,
        "neighbour_information": f"""
            with {COUNTS}, {nearest(quality)}
            select term, round(mi, 8) + 0.0 as mi from scores
        """,
        "sample_n": f"select doc_id, lang from documents order by {hashed(42, 'doc_id')}, doc_id limit 150",
        "split_80_20": f"""
            select o_orderkey, row_number() over (order by {hashed(42, 'o_orderkey')})
                <= ceil(0.2 * (select count(*) from orders)) as is_test
            from orders
        """,
        "stratified_folds": f"""
            select event_id, event_type, ((row_number() over (
                partition by event_type order by {hashed(42, 'event_id')}, event_id) - 1) % 5)::int as fold
            from events
        """,
        "nb_predict": NB + "select id, prediction, round(score, 6) + 0.0 as score from predicted",
        "confusion": NB + "select label, prediction, count(*) as n from predicted group by all",
        "class_scores": NB + CLASS_SCORES + """
            select class, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1
            from per_class
        """,
        "accuracy_f1": NB + CLASS_SCORES + """
            select round((select avg((label = prediction)::int) from predicted), 6) as accuracy,
                round(sum(f1 * support) / sum(support), 6) as f1
            from per_class
        """,
        "score_intervals": NB + f"""
            , weighed as (
                select r, label, prediction, case when r < 0 then 1 else len(list_filter({POISSON_STEPS}, lambda s:
                    ('0x' || left(md5(concat_ws('|', '42', r, id)), 15))::bigint % 1073741824 >= s)) end as w
                from predicted, (select unnest(range(-1, 100)) as r)
            ),
            resampled as (select r, label, prediction, sum(w) as n from weighed group by all),
            by_class as (
                select r, class, sum(hits) as hits, sum(support) as support, sum(guessed) as guessed from (
                    select r, label as class, case when label = prediction then n else 0 end as hits, n as support, 0 as guessed from resampled
                    union all select r, prediction, 0, 0, n from resampled)
                group by r, class
            ),
            by_replicate as (
                select r, sum(hits) / sum(support) as accuracy,
                       sum(case when support + guessed > 0 then 2 * hits / (support + guessed) * support else 0 end) / sum(support) as f1
                from by_class group by r
            ),
            listed as (select r, 'accuracy' as metric, accuracy as score from by_replicate union all select r, 'f1', f1 from by_replicate)
            select metric, round(max(score) filter (where r < 0), 6) + 0.0 as value,
                   round(quantile_cont(score, 0.025) filter (where r >= 0), 6) + 0.0 as low,
                   round(quantile_cont(score, 0.975) filter (where r >= 0), 6) + 0.0 as high
            from listed group by metric
        """,
        "majority_baseline": """
            select quality as label, round(count(*) / (select count(*) from labels)::double, 6) as share
            from labels group by quality order by count(*) desc, quality limit 1
        """,
        "class_distribution": """
            select source as label, count(*) as n, (select count(distinct source) from documents) as classes
            from documents group by source order by n desc, source limit 10
        """,
        "ovr_optimum": f"""
            select label::varchar as label, count(*) as documents, 0.0::double as gradient from ({quality}) group by label
        """,
        "kde_curve": density(),
        "box_stats": """
            with q as (
                select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
                    quantile_cont(value, 0.75) as q3 from events
            )
            select round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
                round(min(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_low,
                round(max(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_high,
                count(*) filter (value not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as outliers
            from events, q group by q1, median, q3
        """,
        "category_counts": 'select event_type as category, count(*) as "count" from events group by event_type',
        "ordered_bars": """
            with listed(position, kind) as (values (0, 'view'), (1, 'click'), (2, 'purchase'), (3, 'refund'))
            select kind, (select count(*) from events where event_type = kind) as "count", position from listed
        """,
        "top_categories": """
            select p_brand as category, count(*) as "count" from part group by p_brand
            order by count(*) desc, p_brand limit 10
        """,
        "word_counts": f"""
            with w as (
                select regexp_replace(unnest(regexp_extract_all(lower(text), {quoted(CLOUD_PATTERN)})), '''s$', '') as word
                from documents
            )
            select word, count(*) as "count" from w
            where word not in {STOP_WORDS} and not regexp_full_match(word, '\\p{{N}}+')
            group by word order by count(*) desc, word limit 200
        """,
        "word_phrases": f"""
            with texts as (
                select list_filter(list_transform(regexp_extract_all(lower(text), {quoted(CLOUD_PATTERN)}), lambda w: regexp_replace(w, '''s$', '')),
                                   lambda w: not regexp_full_match(w, '\\p{{N}}+')) as words
                from documents
            ),
            spoken as (select unnest(words) as word from texts),
            single as (select word, count(*) as n from spoken where word not in {STOP_WORDS} group by word),
            pairs as (select unnest(list_zip(words[:-2], words[2:])) as p from texts where len(words) > 1),
            double as (
                select p[1] as a, p[2] as b, count(*) as n from pairs
                where p[1] not in {STOP_WORDS} and p[2] not in {STOP_WORDS} group by all
            ),
            forms as (
                select s.word, coalesce(t.word, s.word) as form, s.n
                from single s left join single t on s.word like '%s' and s.word not like '%ss' and t.word = s.word[:-2]
            ),
            folded as (select form, sum(n) as n from forms group by form),
            named as (select a || ' ' || b as phrase, n from double),
            merged as (
                select coalesce(t.phrase, s.phrase) as phrase, sum(s.n) as n
                from named s left join named t on s.phrase like '%s' and s.phrase not like '%ss' and t.phrase = s.phrase[:-2]
                group by 1
            ),
            placed as (
                select m.phrase, m.n::double as c, f.form as first, g.form as second, x.n::double as c1, y.n::double as c2,
                       (select sum(n) from single)::double as t
                from merged m
                join forms f on f.word = split_part(m.phrase, ' ', 1) join folded x on x.form = f.form
                join forms g on g.word = split_part(m.phrase, ' ', 2) join folded y on y.form = g.form
            ),
            shares as (select *, c2 / t as p, c / c1 as p1, (c2 - c) / (t - c1) as p2 from placed where t > c1 and t > c2),
            kept as (
                select phrase, c::bigint as n, first, second from shares
                where -2 * (
                    ln(greatest(p, 1e-10)) * c + ln(greatest(1 - p, 1e-10)) * (c1 - c)
                    + ln(greatest(p, 1e-10)) * (c2 - c) + ln(greatest(1 - p, 1e-10)) * (t - c1 - c2 + c)
                    - ln(greatest(p1, 1e-10)) * c - ln(greatest(1 - p1, 1e-10)) * (c1 - c)
                    - ln(greatest(p2, 1e-10)) * (c2 - c) - ln(greatest(1 - p2, 1e-10)) * (t - c1 - c2 + c)
                ) > 30
            ),
            taken as (select form, sum(n) as n from (select first as form, n from kept union all select second, n from kept) group by form),
            counted as (
                select f.form as word, (f.n - coalesce(taken.n, 0))::bigint as "count" from folded f left join taken using (form)
                union all select phrase, n from kept
            )
            select * from counted where "count" > 0
        """,
        "summary_stats": """
            select round(avg(l_quantity), 6) as mean, round(median(l_quantity), 6) as median,
                (select l_quantity from lineitem group by l_quantity order by count(*) desc, l_quantity limit 1) as mode,
                round(stddev_samp(l_quantity), 6) as stdev
            from lineitem
        """,
        "quantiles": """
            with s(share) as (values (0.0::double), (0.1), (0.25), (0.5), (0.75), (0.9), (0.99), (1.0)),
            q as (select quantile_cont(l_extendedprice, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]) as v from lineitem)
            select share, round(v[row_number() over (order by share)], 4) as value from s, q
        """,
        "arff_body": f"""
            select {label('p_partkey')} as p_partkey, p_brand, p_type, {label('p_size')} as p_size,
                p_retailprice as retail_price from part
        """,
        "arff_round_trip": f"""
            select {label('p_partkey')} as p_partkey, p_brand, p_type, {label('p_size')} as p_size,
                p_retailprice as retail_price from part
        """,
        "arff_header": ARFF_HEADER + "select * from header",
        "arff_header_lines": ARFF_HEADER + """
            select attr_pos + 2 as line_no, concat_ws(' ', '@ATTRIBUTE', name, coalesce(domain, type)) as value
            from header
            union all values (0, '@RELATION PART_DATA'), (1, ''), (7, ''), (8, '@DATA')
        """,
        "prepare_lineitem": PREPARED,
    }


ARFF_HEADER = f"""
    with header(attr_pos, name, type, domain) as (
        select 0, 'p_partkey', 'STRING', null::varchar
        union all select 1, 'p_brand', 'NOMINAL',
            (select concat('{{', string_agg(distinct p_brand, ',' order by p_brand), '}}') from part)
        union all select 2, 'p_type', 'NOMINAL',
            (select concat('{{', string_agg(distinct p_type, ',' order by p_type), '}}') from part)
        union all select 3, 'p_size', 'NOMINAL',
            (select concat('{{', string_agg(distinct {label('p_size')}, ',' order by {label('p_size')}), '}}') from part)
        union all select 4, 'retail_price', 'NUMERIC', null
    )
"""
