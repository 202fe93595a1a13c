"""Plain SQL for the registered queries, run by DuckDB on the raw tables."""

from __future__ import annotations

import numpy as np

ITEMS = ("category", "company", "brand")
CCB = "category, company, brand"
DAY_LIMITS = (30, 60, 90, 120, 150, 180, 1000)

SAMPLE = """
txn_base as (
  select case when l.l_orderkey % 101 <> 0 then o.o_custkey end as id,
         100 + c.c_nationkey as chain,
         case when l.l_orderkey % 71 = 0 then 'Mixed'
              when l.l_orderkey % 89 <> 0 then p.p_type end as dept,
         concat(p.p_type, '/', split_part(p.p_name, ' ', 2)) as category,
         s.s_nationkey as company, case when l.l_orderkey % 97 <> 0 then p.p_brand end as brand,
         case when l.l_orderkey % 83 <> 0 then cast(l.l_shipdate as date) end as date,
         cast(l.l_linenumber as double) as productsize, 'EA' as productmeasure,
         cast(case when l.l_returnflag = 'R' then -l.l_quantity else l.l_quantity end as int)
           as purchasequantity,
         cast(case when l.l_returnflag = 'R' then -l.l_extendedprice else l.l_extendedprice end
           as decimal(12,2)) as purchaseamount,
         l.l_orderkey as src
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  join customer c on o.o_custkey = c.c_custkey
  join part p on l.l_partkey = p.p_partkey
  join supplier s on l.l_suppkey = s.s_suppkey),
t as materialized (
  select * exclude (src) from txn_base
  union all select * exclude (src) from txn_base where src % 50 = 0),
ccb_rank as (
  select category, company, brand,
         row_number() over (order by count(*) desc, category, company, brand) as rk
  from t where brand is not null group by category, company, brand),
offers as materialized (
  select rk as offer, category, 1 as quantity, company,
         cast(0.75 + (rk % 4) * 0.25 as decimal(6,2)) as offervalue, brand
  from ccb_rank where rk <= 35
  union all
  select 36, category, 1, company, cast(3.00 as decimal(6,2)), brand from ccb_rank where rk = 1
  union all
  select 37, category, 1, 999, cast(1.50 as decimal(6,2)), 'Brand#99'
  from ccb_rank where rk = 2),
own_offer as (
  select t.id, min(f.offer) as offer from t
  join offers f on t.category = f.category and t.company = f.company and t.brand = f.brand
  group by t.id),
known as (
  select c.*, w.offer as own from customer c left join own_offer w on w.id = c.c_custkey),
shoppers as (
  select c_custkey, c_nationkey, own from known
  union all select c_custkey + 10000000, c_nationkey, own from known where c_custkey % 37 = 0),
history as (
  select c.c_custkey as id, 100 + c.c_nationkey as chain,
         case when c.c_custkey % 29 = 0 then 99
              when c.c_custkey % 11 = 0 then 37 when c.c_custkey % 13 = 0 then 36
              else coalesce(c.own, c.c_custkey % 35 + 1) end as offer,
         c.c_nationkey as market, cast(c.c_custkey % 5 as int) as repeattrips,
         case when c.c_custkey % 4 = 0 then 't' else 'f' end as repeater,
         date '2001-05-01' + cast(c.c_custkey % 150 as int) as offerdate
  from shoppers c),
train as (select * from history where id % 3 <> 0 and offer not in (30, 31, 32)),
test as (select id, chain, offer, market, offerdate from history where id % 3 = 0 and offer > 4),
dept_of as (
  select category, dept from (
    select category, dept,
           row_number() over (partition by category order by max(date) desc, dept desc) as place
    from t where dept is not null group by category, dept) where place = 1),
"""


def _steps(history: str, before_offer: bool) -> str:
    label = (
        "h.repeattrips, case h.repeater when 't' then '1' when 'f' then '0'"
        " else h.repeater end as label, "
        if history == "train"
        else ""
    )
    cut = "where cast(h.offerdate as date) - cast(t.date as date) > 0" if before_offer else ""
    return f"""
spine as (
  select h.id, h.chain, h.offer, h.market, {label}h.offerdate,
         f.category, f.quantity, f.company, f.offervalue, f.brand
  from {history} h join offers f on h.offer = f.offer),
h as materialized (select s.*, d.dept from spine s join dept_of d on s.category = d.category),
e as materialized (
  select t.id, t.date, h.offerdate, t.category, t.company, t.brand, t.dept,
         t.purchasequantity as q, t.purchaseamount as a,
         cast(cast(h.offerdate as date) - cast(t.date as date) as int) as dd,
         t.category = h.category as same_category, t.company = h.company as same_company,
         t.brand = h.brand as same_brand, t.dept = h.dept as same_dept,
         t.category = h.category and t.company = h.company and t.brand = h.brand as own
  from t join h on t.id = h.id {cut})
"""


def _with(
    query: str, *steps: str, history: str = "train", before_offer: bool = False
) -> str:
    parts = [_steps(history, before_offer), *steps]
    return f"with {SAMPLE} {', '.join(parts)} {query}"


AMOUNT = "cast(purchaseamount as double) as purchaseamount"
ROW = (
    "id, chain, dept, category, company, brand, date, productsize, productmeasure,"
    f" purchasequantity, {AMOUNT}"
)
IN_ANY = (
    "category in (select category from offers) or company in (select company from offers)"
    " or brand in (select brand from offers)"
)
IN_UNIVERSE = "category in (select category from offers) or company in (select company from offers)"
IN_PRODUCT = f"({CCB}) in (select ({CCB}) from offers)"
EVENT = (
    "id, {}, offerdate, date, q as purchasequantity, cast(a as double) as purchaseamount,"
    " dd as day_diff"
)


def _wanted(item: str) -> str:
    return f"select {EVENT.format(item)} from e where same_{item}"


def _money(condition: str) -> str:
    return f"cast(coalesce(sum(a) filter (where {condition}), 0) as double)"


def _whole(expression: str, condition: str) -> str:
    return f"cast(coalesce({expression} filter (where {condition}), 0) as bigint)"


def _grid(measure: str, start: int) -> dict[str, str]:
    out = {}
    for item in ITEMS:
        for limit in DAY_LIMITS:
            condition = f"same_{item} and dd <= {limit}"
            out[f"X{start + len(out)}"] = {
                "n": _whole("count(*)", condition),
                "a": _money(condition),
                "q": _whole("sum(q)", condition),
            }[measure]
    return out


def _ever(item: str) -> str:
    return f"max(case when same_{item} then 1 else 0 end)"


EVER = {f"X{i + 1}": _ever(item) for i, item in enumerate(ITEMS)}
TOTAL = {"X7": "cast(sum(a) as double)"}
COUNTS, AMOUNTS, QUANTITIES = _grid("n", 9), _grid("a", 30), _grid("q", 51)
SPEND_30 = {"X73": _money("dd <= 29")}
OWN_30 = {"X74": _money("own and dd <= 29"), "X75": _whole("sum(q)", "own and dd <= 29")}
OWN = {"X76": _money("own"), "X77": _whole("sum(q)", "own")}
DEPT_30 = {
    "X78": _money("same_dept and dd <= 29"),
    "X79": _whole("sum(q)", "same_dept and dd <= 29"),
}
VISITS = {"X80": "count(distinct date) filter (where dd <= 29)"}
RECENCY = {"X81": "max(dd)", "X82": "min(dd)"}
RETURNED = {"X83": "case when min(a) filter (where own) < 0 then 1 else 0 end"}
INTERACTIONS = {
    "X4": " * ".join(_ever(i) for i in ITEMS),
    "X5": f"{_ever('company')} * {_ever('brand')}",
    "X6": f"{_ever('category')} * {_ever('brand')}",
}


def _int(columns: dict[str, str]) -> dict[str, str]:
    return {name: f"cast({sql} as int)" for name, sql in columns.items()}


EVER, INTERACTIONS, RETURNED, RECENCY = map(_int, (EVER, INTERACTIONS, RETURNED, RECENCY))


def _per_shopper(*blocks: dict[str, str]) -> str:
    columns = [f"{sql} as {name}" for block in blocks for name, sql in block.items()]
    return f"select id, {', '.join(columns)} from e group by id"


PRODUCT_COUNTS = f"select {CCB}, count(*) as product_rows from t where {IN_PRODUCT} group by {CCB}"


def _category_counts(dedupe: str) -> str:
    return (
        f"select category, count(*) as category_rows from (select {dedupe} * from t"
        " where category in (select category from offers)) group by category"
    )


def _market_share(dedupe: str = "distinct") -> str:
    return (
        f"select p.category, p.company, p.brand, p.product_rows / c.category_rows as X84"
        f" from ({PRODUCT_COUNTS}) p join ({_category_counts(dedupe)}) c"
        " on p.category = c.category"
    )


USERS = "(select count(distinct id) from t)"
SHARE_PRODUCT = (
    f"select {CCB}, count(distinct id) / {USERS} as X86 from t where {IN_PRODUCT} group by {CCB}"
)
SHARE_CATEGORY = (
    f"select category, count(distinct id) / {USERS} as X87 from t"
    " where category in (select category from offers) group by category"
)
SPEND_OR_SHARE = "case when X76 >= X84 then X76 else X84 * -100 end as X85"


def _universe(before_offer: bool = False) -> str:
    rows = f"select distinct * from t where {IN_UNIVERSE}"
    if before_offer:
        rows = (
            f"select u.* from ({rows}) u join h on u.id = h.id"
            " where cast(h.offerdate as date) - cast(u.date as date) > 0"
        )
    spend = f"select id, cast(sum(purchaseamount) as double) as X72 from ({rows}) group by id"
    return f"select h.id, coalesce(u.X72, 0) as X72 from h left join ({spend}) u on h.id = u.id"


BASE = _per_shopper(EVER, INTERACTIONS, TOTAL, COUNTS, AMOUNTS, QUANTITIES)
LOOKED = _per_shopper(
    EVER, INTERACTIONS, TOTAL, COUNTS, AMOUNTS, QUANTITIES,
    SPEND_30, OWN_30, OWN, DEPT_30, VISITS, RECENCY, RETURNED,
)


def _kept(history: str) -> str:
    label = "h.repeattrips, h.label, " if history == "train" else ""
    return f"h.chain, h.offer, h.market, {label}cast(h.offervalue as double) as X8"


def _base(drop: str = "") -> str:
    exclude = f"exclude ({drop})" if drop else ""
    return _with(f"select b.* {exclude}, {_kept('train')} from ({BASE}) b join h on b.id = h.id")


def _matrix(history: str = "train", before_offer: bool = False, extra: str = "") -> str:
    return _with(
        f"select l.*, {_kept(history)}{extra}, u.X72, m.X84, {SPEND_OR_SHARE}, p.X86, c.X87"
        f" from ({LOOKED}) l join h on l.id = h.id"
        f" join ({_universe(before_offer)}) u on u.id = l.id"
        f" join ({_market_share()}) m using ({CCB})"
        f" join ({SHARE_PRODUCT}) p using ({CCB})"
        f" join ({SHARE_CATEGORY}) c using (category)",
        history=history,
        before_offer=before_offer,
    )


def _by_offer(before_offer: bool = False) -> str:
    """The matrix with a row per shopper and offer: events are joined with each offer."""
    steps = _steps("train", before_offer).replace("from train h", "from several h")
    steps = steps.replace("select t.id, t.date,", "select t.id, h.offer, t.date,")
    looked = LOOKED.replace("select id,", "select id, offer,").replace("by id", "by id, offer")
    universe = f"select distinct * from t where {IN_UNIVERSE}"
    cut = "cast(h.offerdate as date) - cast(u.date as date) > 0" if before_offer else "true"
    spend = (
        "select h.id, h.offer, coalesce(cast(sum(u.purchaseamount) as double), 0) as X72"
        f" from h left join ({universe}) u on h.id = u.id and {cut} group by h.id, h.offer"
    )
    several = """several as (
  select * from train union all
  select * replace (offer % 35 + 1 as offer, cast(cast(offerdate as date) + 20 as date) as offerdate)
  from train where id % 3 = 1)"""
    return (
        f"with {SAMPLE} {several}, {steps}"
        f" select l.*, {_kept('train').replace('h.offer, ', '')}, u.X72, m.X84, {SPEND_OR_SHARE},"
        f" p.X86, c.X87 from ({looked}) l join h on l.id = h.id and l.offer = h.offer"
        " join (" + spend + ") u on u.id = l.id and u.offer = l.offer"
        f" join ({_market_share()}) m using ({CCB})"
        f" join ({SHARE_PRODUCT}) p using ({CCB})"
        f" join ({SHARE_CATEGORY}) c using (category)"
    )


# --- clustering: z-scores, then one step from the most frequent values ------

NUMBERS = ("purchasequantity", "purchaseamount", "day_diff")


def _z(column: str, source: str) -> str:
    x = f"cast({source} as double)"
    spread = f"stddev_pop({x}) over (partition by item)"
    return f"({x} - avg({x}) over (partition by item)) / {spread} as {column}"


MATCHES = " union all ".join(
    f"select '{item}' as item, cast({item} as varchar) as value, id, q, a, dd"
    f" from e where same_{item} and dd is not null"
    for item in ITEMS
)
SCALED = (
    f"z as materialized (select id, item, value, {_z('purchasequantity', 'q')},"
    f" {_z('purchaseamount', 'a')}, {_z('day_diff', 'dd')} from ({MATCHES}))"
)
STARTS = (
    "starts as (select * from (select item, value as mode,"
    + ", ".join(f" avg({c}) as {c}" for c in NUMBERS)
    + ", row_number() over (partition by item order by count(*) desc, value) - 1 as cluster"
    " from z group by item, value) where cluster < 3)"
)
ASSIGNED = (
    "assigned as (select item, value, cluster, distance, "
    + ", ".join(NUMBERS)
    + " from (select z.*, s.cluster, s.distance, row_number() over"
    " (partition by z.row order by s.distance, s.cluster) as place from"
    " (select *, row_number() over () as row from z) z"
    " join lateral (select cluster, "
    + " + ".join(f"(z.{c} - s.{c}) * (z.{c} - s.{c})" for c in NUMBERS)
    + " + case when z.value = s.mode then 0 else 0.5 end as distance"
    " from starts s where s.item = z.item) s on true) where place = 1)"
)
MODES = (
    "modes as (select item, cluster, value as mode from (select item, cluster, value,"
    " row_number() over (partition by item, cluster order by count(*) desc, value desc) as place"
    " from assigned group by item, cluster, value) where place = 1)"
)


def _starts(ks: tuple[int, ...], seed: int | None = None, runs: int = 1) -> str:
    """Prototypes of every fit before the first pass: (item, k, run, cluster, mode, numbers)."""
    tops = (
        "(select item, value, "
        + ", ".join(f"avg({c}) as {c}" for c in NUMBERS)
        + ", row_number() over (partition by item order by count(*) desc, value) - 1 as place"
        " from z group by item, value)"
    )
    if seed is None:
        numbers = ", ".join(f"t.{c}" for c in NUMBERS)
        draws = [(k, 0, j, ()) for k in ks for j in range(k)]
        values = ", ".join(f"({k}, {run}, {j})" for k, run, j, _ in draws)
        drawn = f"(values {values}) d(k, run, cluster)"
    else:
        numbers = ", ".join(f"m.mean_{c} + d.d_{c} * m.std_{c} as {c}" for c in NUMBERS)
        rows = []
        for k in ks:
            for run in range(runs):
                draw = np.random.default_rng([seed, run, k]).standard_normal((k, len(NUMBERS)))
                rows += [(k, run, j, *map(repr, map(float, draw[j]))) for j in range(k)]
        values = ", ".join(f"({k}, {run}, {j}, {', '.join(d)})" for k, run, j, *d in rows)
        drawn = f"(values {values}) d(k, run, cluster, {', '.join(f'd_{c}' for c in NUMBERS)})"
    spreads = (
        "(select item, count(distinct value) as n_values, "
        + ", ".join(f"avg({c}) as mean_{c}, stddev_pop({c}) as std_{c}" for c in NUMBERS)
        + " from z group by item)"
    )
    return (
        f"select t.item, d.k, d.run, d.cluster, t.value as mode, {numbers}, 0 as pass,"
        " cast('infinity' as double) as cost, false as settled"
        f" from {drawn} join {spreads} m on true"
        f" join {tops} t on t.item = m.item and t.place = d.cluster % m.n_values"
    )


def _passes(ks: tuple[int, ...], seed: int | None = None, runs: int = 1) -> str:
    """All passes of all fits until each settles, emptied clusters refilled."""
    gaps = " + ".join(f"(z.{c} - f.{c}) * (z.{c} - f.{c})" for c in NUMBERS)
    fit, numbers = "item, k, run", ", ".join(NUMBERS)
    of_f = "f.item, f.k, f.run"
    new = ", ".join(f"sum({c}) / sum(n) as {c}" for c in NUMBERS)
    steps = f"""
  places as (
    select {of_f}, f.cluster, z.value, {", ".join(f"z.{c}" for c in NUMBERS)}, z.row,
           {gaps} + case when z.value = f.mode then 0 else 0.5 end as distance
    from (select *, row_number() over () as row from z) z join fits f on f.item = z.item
    where not f.settled and f.pass < 100),
  nearest as (
    select * from (select *, row_number() over
      (partition by {fit}, row order by distance, cluster) as place from places) where place = 1),
  counted as (
    select {fit}, cluster, value, count(*) as n, sum(distance) as cost,
           {", ".join(f"sum({c}) as {c}" for c in NUMBERS)}
    from nearest group by {fit}, cluster, value),
  news as (
    select {fit}, cluster, arg_max(value, {{'n': n, 'value': value}}) as mode, {new}, sum(n) as n
    from counted group by {fit}, cluster),
  emptied as (
    select {of_f}, f.cluster, row_number() over (partition by {of_f} order by f.cluster) as e,
           count(*) over (partition by {of_f}) as wanted
    from fits f left join news n using ({fit}, cluster)
    where n.mode is null and not f.settled and f.pass < 100),
  largest as (
    select {fit}, arg_max(cluster, {{'n': n, 'low': -cluster}}) as cluster from news group by {fit}),
  worst as (
    select {fit}, value, {numbers}, row_number() over
      (partition by {fit} order by distance desc, value, {numbers}) as r,
      count(*) over (partition by {fit}) as held
    from nearest join largest using ({fit}, cluster) where distance > 0),
  refills as (
    select e.item, e.k, e.run, e.cluster, w.value, {", ".join(f"w.{c}" for c in NUMBERS)}
    from emptied e join worst w using ({fit}) where w.r = least(e.wanted, w.held) - e.e + 1),
  moves as (
    select {of_f}, f.cluster, f.mode as old_mode, {", ".join(f"f.{c} as old_{c}" for c in NUMBERS)},
           coalesce(n.mode, r.value, f.mode) as mode,
           {", ".join(f"coalesce(n.{c}, r.{c}, f.{c}) as {c}" for c in NUMBERS)},
           r.value is not null as refilled, f.pass, f.cost as old_cost
    from fits f left join news n using ({fit}, cluster) left join refills r using ({fit}, cluster)
    where not f.settled and f.pass < 100),
  costs as (select {fit}, sum(cost) as cost from counted group by {fit}),
  stills as (
    select {fit}, any_value(c.cost) as cost, not bool_or(refilled) and (
             any_value(c.cost) >= any_value(old_cost) or not bool_or(mode <> old_mode or {
               " or ".join(f"abs({c} - old_{c}) > 1e-9" for c in NUMBERS)})) as still
    from moves join costs c using ({fit}) group by {fit})
  select {fit}, cluster, case when still then old_mode else mode end as mode,
         {", ".join(f"case when still then old_{c} else {c} end as {c}" for c in NUMBERS)},
         pass + 1 as pass, least(s.cost, old_cost) as cost, still as settled
  from moves join stills s using ({fit})"""
    return (
        f"fits as (select {fit}, cluster, mode, {numbers}, pass, cost, settled"
        f" from ({_starts(ks, seed, runs)}) union all (with {steps}))"
    )


def _elbow(ks: tuple[int, ...], seed: int | None = None, runs: int = 1) -> str:
    return _with(
        "select item, k, round(min(cost), 4) as cost from fits where settled group by item, k",
        SCALED,
        _passes(ks, seed, runs),
    ).replace("with ", "with recursive ", 1)


def _rounded(columns: tuple[str, ...], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)


GAPS = " + ".join(f"(z.{c} - f.{c}) * (z.{c} - f.{c})" for c in NUMBERS)
SOLD = (
    "select 1 from t where t.category = spine.category and t.company = spine.company"
    " and t.brand = spine.brand"
)


def _left_out(before_offer: bool = False) -> str:
    """The history without the matrix, by the steps of the matrix itself."""
    return _with(
        "select id from train except"
        f" (select l.id from ({LOOKED}) l join h on l.id = h.id join ({_market_share()}) m using ({CCB}))",
        before_offer=before_offer,
    )


def oracle_sql() -> dict[str, str]:
    out = {
        "scan_offers": _with(
            "select offer, category, quantity, company,"
            " cast(offervalue as double) as offervalue, brand from offers"
        ),
        "scan_history": _with("select * from train"),
        "scan_test_history": _with("select * from test"),
        "scan_transactions": _with(f"select {ROW} from t"),
        "scan_good_lines": _with(f"select {ROW} from t"),
        "bad_lines": _with(
            "select id, 'no date' as date, count(*) as lines from t where id % 50 = 0 group by id"
        ),
        "saved_reduction": _with(f"select {ROW} from t where {IN_ANY}"),
        "saved_dept_map": _with("select category, dept from dept_of"),
        "saved_features": _base(),
        "features_from_files": _matrix(),
        "features_from_files_test": _matrix(history="test"),
        "features_from_buckets": _matrix(),
        "features_after_change": _matrix(),
        "features_after_append": _matrix(),
        "spine": _with("select * replace (cast(offervalue as double) as offervalue) from spine"),
        "spine_test": _with(
            "select * replace (cast(offervalue as double) as offervalue) from spine",
            history="test",
        ),
        "recode_label": _with(
            "select id, repeater, case repeater when 't' then '1' when 'f' then '0'"
            " else repeater end as label from train"
        ),
        "category_dept_map": _with("select category, dept from dept_of"),
        "category_dept_map_by_file": _with(
            "select category, dept from t where category is not null and dept is not null"
            " qualify row_number() over (partition by category order by date desc nulls last,"
            " productsize desc, purchaseamount desc, dept desc) = 1"
        ),
        "category_dept_conflicts": _with(
            "select category, count(distinct dept) as depts from t"
            " group by category having count(distinct dept) > 1"
        ),
        "spine_dept": _with("select id, offer, category, dept from h"),
        "duplicate_ids": _with(
            "select id, count(*) as rows from"
            " (select id from train union all select id from train where id % 50 = 1)"
            " group by id having count(*) > 1"
        ),
        "reduce_transactions": _with(f"select {ROW} from t where {IN_ANY}"),
        "reduce_by_filter": _with(f"select {ROW} from t where {IN_ANY}"),
        "reduce_stats": _with(
            f"select count(*) as searched, count(*) filter (where {IN_ANY}) as kept from t"
        ),
        "offer_key_counts": _with(
            "select count(distinct category) as categories, count(distinct company) as companies,"
            " count(distinct brand) as brands from offers"
        ),
        "semi_category": _with(
            f"select {ROW} from t where category in (select category from offers)"
        ),
        "semi_category_by_filter": _with(
            f"select {ROW} from t where category in (select category from offers)"
        ),
        "semi_company": _with(
            f"select {ROW} from t where company in (select company from offers)"
        ),
        "offer_product_events": _with(f"select {ROW} from t where {IN_PRODUCT}"),
        "offer_category_events": _with(
            f"select distinct {ROW} from t where category in (select category from offers)"
        ),
        "offer_universe_rows": _with(f"select distinct {ROW} from t where {IN_UNIVERSE}"),
        "offers_in_common": _with("select offer from train intersect select offer from test"),
        "offers_union": _with("select offer from train union select offer from test"),
        "offer_frequency": _with(
            "select offer, count(*) as shoppers from train group by offer"
        ),
        "offer_train_vs_test": _with(
            "select coalesce(a.offer, b.offer) as offer, coalesce(a.n, 0) as train_offer,"
            " coalesce(b.n, 0) as test_offer"
            " from (select offer, count(*) as n from train group by offer) a"
            " full join (select offer, count(*) as n from test group by offer) b"
            " on a.offer = b.offer"
        ),
        "ids_bought_category": _with(
            "select id from train intersect select id from e where same_category"
        ),
        "ids_without_universe_spend": _with(
            f"select id from train except select id from t where {IN_UNIVERSE}"
        ),
        "ids_without_offered_product": _with(
            f"select id from train except select id from t where {IN_PRODUCT}"
        ),
        "attach_zero_fill": _with(
            "select s.id, s.offer, coalesce(cast(x.spend as double), 0) as own_spend from spine s"
            " left join (select id, sum(a) as spend from e where own group by id) x on s.id = x.id"
        ),
        "attach_inner": _with(
            "select s.id, s.offer, cast(x.spend as double) as own_spend from spine s"
            " join (select id, sum(a) as spend from e where own group by id) x on s.id = x.id"
        ),
        "history_events": _with(
            "select id, offerdate, date, cast(a as double) as purchaseamount, dd as day_diff from e"
        ),
        "history_events_before_offer": _with(
            "select id, offerdate, date, cast(a as double) as purchaseamount, dd as day_diff"
            " from e where dd > 0"
        ),
        "day_diff": _with("select dd as day_diff, count(*) as events from e group by dd"),
        "window_mask_30": _with("select id, date, dd as day_diff, dd <= 30 as within_30 from e"),
        "own_product_events": _with(f"select {EVENT.format(CCB)} from e where own"),
        "own_dept_events": _with(f"select {EVENT.format('dept')} from e where same_dept"),
        "feat_offer_value": _with("select id, cast(offervalue as double) as X8 from spine"),
        "feat_offer_universe_spend": _with(_universe()),
        "shopper_totals": _with(
            "select id, cast(sum(purchaseamount) as double) as X7 from t"
            " where id is not null group by id"
        ),
        "user_count": _with("select count(distinct id) as users from t"),
        "product_counts": _with(PRODUCT_COUNTS),
        "category_counts": _with(_category_counts("distinct")),
        "feat_marketshare": _with(_market_share()),
        "feat_marketshare_all_rows": _with(_market_share("")),
        "feat_customer_share_product": _with(SHARE_PRODUCT),
        "feat_customer_share_category": _with(SHARE_CATEGORY),
        "feat_spend_or_share": _with(
            f"select o.id, {SPEND_OR_SHARE} from ({_per_shopper(OWN)}) o join h on o.id = h.id"
            f" join ({_market_share()}) m using ({CCB})"
        ),
        "base_features": _base(),
        "base_features_from_reduction": _base(drop="X7").replace(
            "from e group by id",
            "from e where id in (select id from t where " + IN_ANY + ") group by id",
        ),
        "feature_matrix": _matrix(),
        "feature_matrix_returned": _matrix(
            extra=", h.offerdate, category, company, brand, h.dept, h.quantity"
        ),
        "feature_matrix_before_offer": _matrix(before_offer=True),
        "feature_matrix_by_offer": _by_offer(),
        "feature_matrix_by_offer_before": _by_offer(before_offer=True),
        "feature_matrix_test": _matrix(history="test"),
        "dropped_shoppers": _with(
            "select id, 'unknown offer' as reason from train"
            " where offer not in (select offer from offers)"
            " union all select id, 'no purchases' from spine where id not in (select id from e)"
            " union all select id, 'product never sold' from spine"
            f" where id in (select id from e) and not exists ({SOLD})"
        ),
        "dropped_shoppers_before_offer": _with(
            "select id, 'unknown offer' as reason from train"
            " where offer not in (select offer from offers)"
            " union all select id, 'no purchases' from spine where id not in (select id from e)"
            " union all select id, 'no purchases before the offer' from spine"
            " where id in (select id from e) and id not in (select id from e where dd > 0)"
            " union all select id, 'product never sold' from spine"
            f" where id in (select id from e where dd > 0) and not exists ({SOLD})"
        ),
        "left_out": _left_out(),
        "left_out_before_offer": _left_out(before_offer=True),
        "kproto_cost_k1": _with(
            "select item, cast(3 * count(*) + 0.5 * (count(*) - any_value(most)) as double) as cost"
            " from z join (select item, max(n) as most from"
            " (select item, value, count(*) as n from z group by item, value) group by item) m"
            " using (item) group by item",
            SCALED,
        ),
        "kproto_assign_step": _with(
            "select item, value, cast(cluster as int) as cluster,"
            " round(distance, 5) as distance from assigned",
            SCALED, STARTS, ASSIGNED,
        ),
        "kproto_elbow": _elbow((1, 2, 3, 4, 5, 6)),
        "kproto_random_starts": _elbow((2, 3), seed=1, runs=2),
        "kproto_labels": _with(
            f"select id, item, value, {_rounded(NUMBERS)}, cast(k as int) as k,"
            " cast(cluster as int) as cluster, round(distance, 5) as distance from ("
            f"select z.*, f.k, f.cluster, {GAPS} + case when z.value = f.mode then 0 else 0.5 end"
            " as distance, row_number() over (partition by z.row order by "
            f"{GAPS} + case when z.value = f.mode then 0 else 0.5 end, f.cluster) as place"
            " from (select *, row_number() over () as row from z) z"
            " join fits f on f.item = z.item and f.settled) where place = 1",
            SCALED, _passes((3,)),
        ).replace("with ", "with recursive ", 1),
        "kproto_update_step": _with(
            "select item, cast(cluster as int) as cluster, n, mode, "
            + _rounded(NUMBERS)
            + " from (select item, cluster, count(*) as n, "
            + ", ".join(f"avg({c}) as {c}" for c in NUMBERS)
            + " from assigned group by item, cluster) join modes using (item, cluster)",
            SCALED, STARTS, ASSIGNED, MODES,
        ),
    }
    for item in ITEMS:
        out[f"wanted_{item}"] = _with(_wanted(item))
        out[f"zscore_{item}"] = _with(
            f"select {'cast(value as varchar)'} as {item}, {_rounded(NUMBERS)}"
            f" from z where item = '{item}'",
            SCALED,
        )
    for name, block in {
        "feat_ever_bought": EVER,
        "feat_interactions": INTERACTIONS,
        "feat_total_spend": TOTAL,
        "feat_windowed_counts": COUNTS,
        "feat_windowed_amounts": AMOUNTS,
        "feat_windowed_quantities": QUANTITIES,
        "feat_spend_30": SPEND_30,
        "feat_own_product_30": OWN_30,
        "feat_own_product_all": OWN,
        "feat_dept_30": DEPT_30,
        "feat_visits_30": VISITS,
        "feat_recency": RECENCY,
        "feat_returned": RETURNED,
    }.items():
        out[name] = _with(_per_shopper(block))
    return out
