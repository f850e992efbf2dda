"""Independent SQL twins (DuckDB dialect) of the Spark operators.

Each twin is written from the operator's definition, not generated from the
Spark plan; shared steps are named CTEs that ``sql_with`` pulls in, with
their dependencies, in definition order.
"""

from __future__ import annotations

from shoplens.functions.text import CONTRACTION_RULES

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql_with(uses: list[str], select: str) -> str:
    names = _closure(uses)
    if not names:
        return select
    parts = [f"{n} AS ({CTES[n][1]})" for n in names]
    body = select.lstrip()
    if body[:5].lower() == "with ":
        # merge the query's own CTEs into one WITH list
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + select


def round_floats(sql: str, floats: tuple[str, ...]) -> str:
    if not floats:
        return sql
    rep = ", ".join(f"floor({c} * 1048576.0 + 0.5) / 1048576.0 AS {c}" for c in floats)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _t"


# ---------------------------------------------------------------- events
cte("shop", [], """
 select e.ts as event_time,
  case e.event_type when 'click' then 'cart' when 'error' then 'remove_from_cart'
       when 'signup' then 'view' else e.event_type end as event_type,
  p.p_partkey as product_id, cast(p.p_size as bigint) as category_id,
  case when p.p_size % 5 = 0 then null when p.p_size % 7 = 0 then lower(p.p_type)
       else concat(lower(p.p_type), '.', replace(p.p_name, ' ', '.')) end as category_code,
  case when e.event_id % 4 = 0 then null
       when p.p_partkey % 10 = 0 and e.event_id % 3 = 0 then concat(p.p_brand, '-alt')
       else p.p_brand end as brand,
  case when e.event_id % 97 = 0 then cast(0 as double) when e.event_id % 211 = 0 then cast(-1 as double)
       else e.value end as price,
  e.user_id, concat(cast(e.user_id as varchar), '-', cast(cast(e.ts as date) as varchar)) as user_session
 from (select * from events union all select * from events where event_id % 50 = 0) e
 join part p on p.p_partkey = cast(json_extract_string(e.props, '$.k') as bigint)""")

cte("c_dedup", ["shop"], "select distinct * from shop")
cte("c_pos", ["c_dedup"], "select * from c_dedup where not coalesce(price < 0, false)")
cte("c_split", ["c_pos"], """
 select event_time, event_type, product_id, category_id,
  split_part(category_code, '.', 1) as main_category,
  case when strpos(category_code, '.') > 0 then substr(category_code, strpos(category_code, '.') + 1) end as sub_category,
  brand, price, user_id, user_session from c_pos""")
cte("c_canon", ["c_split"], """
 select product_id, first(brand order by event_time, brand) as canonical_brand
 from c_split where brand is not null and brand <> '' and lower(brand) <> 'nan'
 group by product_id""")
cte("c_brand", ["c_split", "c_canon"], """
 select s.event_time, s.event_type, s.product_id, s.category_id, s.main_category, s.sub_category,
  coalesce(c.canonical_brand, s.brand) as brand, s.price, s.user_id, s.user_session
 from c_split s left join c_canon c on s.product_id = c.product_id""")
cte("c_sess", ["c_brand"], """
 select event_time, event_type, product_id, category_id, main_category, sub_category, brand, price, user_id, user_session
 from (select *, row_number() over (partition by event_type, product_id, user_id, user_session
        order by event_time, category_id nulls first, main_category nulls first, sub_category nulls first,
                 brand nulls first, price nulls first) as rn
       from c_brand where event_type in ('cart', 'remove_from_cart')) where rn = 1
 union all
 select * from c_brand where event_type is null or event_type not in ('cart', 'remove_from_cart')""")
cte("clean", ["c_sess"], """
 select cast(event_time as date) as date, cast(isodow(event_time) - 1 as integer) as weekday,
  strftime(event_time, '%H:%M:%S') as time, event_type, product_id, category_id, main_category,
  sub_category, brand, price, user_id, user_session from c_sess""")

# ---------------------------------------------------------------- features
cte("cat_q", ["clean"], """
 select category_id, quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.5) as med,
  quantile_cont(price, 0.75) as q3 from clean where category_id is not null group by category_id""")
cte("rel", ["clean", "cat_q"], """
 select c.date, c.weekday, c.time, c.event_type, c.product_id, c.category_id, c.main_category,
  c.sub_category, c.brand, c.price,
  case when q.q3 - q.q1 = 0 then cast(0 as double)
       when c.price is null or q.q1 is null then null
       else greatest(cast(-10 as double), least(cast(10 as double), (c.price - q.med) / (q.q3 - q.q1))) end
   as relative_price,
  c.user_id, c.user_session
 from clean c left join cat_q q on c.category_id = q.category_id""")


def _rates_sql(src: str, key: str, extra: str) -> str:
    """Raw rates -> weighted by share of total -> fill 0 -> min-max."""
    def rate(a, b):
        return f"100.0 * (case when {b} = 0 then cast({a} as double) else {a} / {b} end)"
    return f"""
 with r0 as (select *, {rate('carts', 'views')} as r_cv, {rate('purchases', 'views')} as r_pv,
      {rate('remove_from_carts', 'carts')} as r_rc, {rate('purchases', 'carts')} as r_pc from {src}),
 tot as (select sum(views) as tv, sum(carts) as tc from {src}),
 r1 as (select r0.*,
   coalesce(r_cv * (case when tv = 0 then null else views / tv end), 0) as cart_per_view,
   coalesce(r_pv * (case when tv = 0 then null else views / tv end), 0) as purchase_per_view,
   coalesce(r_rc * (case when tc = 0 then null else carts / tc end), 0) as remove_per_cart,
   coalesce(r_pc * (case when tc = 0 then null else carts / tc end), 0) as purchase_per_cart
   from r0, tot),
 mm as (select min(cart_per_view) a1, max(cart_per_view) b1, min(purchase_per_view) a2, max(purchase_per_view) b2,
   min(remove_per_cart) a3, max(remove_per_cart) b3, min(purchase_per_cart) a4, max(purchase_per_cart) b4 from r1)
 select {key}, {extra},
  case when b1 - a1 = 0 then null else (cart_per_view - a1) / (b1 - a1) end as cart_per_view,
  case when b2 - a2 = 0 then null else (purchase_per_view - a2) / (b2 - a2) end as purchase_per_view,
  case when b3 - a3 = 0 then null else (remove_per_cart - a3) / (b3 - a3) end as remove_per_cart,
  case when b4 - a4 = 0 then null else (purchase_per_cart - a4) / (b4 - a4) end as purchase_per_cart
 from r1, mm"""


cte("prod_base", ["rel"], """
 select product_id, min(date) as first_date, max(date) as last_date,
  first(category_id order by date, time) filter (where category_id is not null) as category_id,
  avg(price) as avg_price, avg(relative_price) as relative_price,
  count(*) filter (where event_type = 'view') as views,
  count(*) filter (where event_type = 'cart') as carts,
  count(*) filter (where event_type = 'remove_from_cart') as remove_from_carts,
  count(*) filter (where event_type = 'purchase') as purchases
 from rel group by product_id""")
cte("product_tbl", ["prod_base"], _rates_sql(
    "prod_base", "product_id",
    "first_date, last_date, category_id, avg_price, relative_price, views, carts, remove_from_carts, purchases"))

cte("user_base", ["rel"], """
 select user_id, min(date) as first_date, max(date) as last_date,
  count(*) filter (where event_type = 'view') as views,
  count(*) filter (where event_type = 'cart') as carts,
  count(*) filter (where event_type = 'remove_from_cart') as remove_from_carts,
  count(*) filter (where event_type = 'purchase') as purchases,
  coalesce(avg(price) filter (where event_type = 'view'), 0) as avg_view_price,
  coalesce(avg(price) filter (where event_type = 'cart'), 0) as avg_purchase_price,
  coalesce(avg(relative_price) filter (where event_type = 'view'), 0) as avg_view_relative_price,
  coalesce(avg(relative_price) filter (where event_type = 'cart'), 0) as avg_purchase_relative_price,
  count(distinct product_id) filter (where event_type = 'view') as distinct_view_product,
  count(distinct product_id) filter (where event_type = 'cart') as distinct_cart_product,
  count(distinct product_id) filter (where event_type = 'remove_from_cart') as distinct_remove_product,
  count(distinct product_id) filter (where event_type = 'purchase') as distinct_purchase_product
 from rel group by user_id""")
cte("user_tbl", ["user_base"], _rates_sql(
    "user_base", "user_id",
    "first_date, last_date, views, carts, remove_from_carts, purchases, avg_view_price, avg_purchase_price, "
    "avg_view_relative_price, avg_purchase_relative_price, distinct_view_product, distinct_cart_product, "
    "distinct_remove_product, distinct_purchase_product"))

cte("interaction", ["rel"], """
 select user_id, product_id,
  greatest(cast(0 as double), least(cast(100 as double), sum(
   (case event_type when 'view' then 0.1 when 'cart' then 0.4 when 'remove_from_cart' then -0.3
      when 'purchase' then 1.0 else 0.0 end)::double
   * exp(ln(0.5) * (date_diff('day', date, (select max(date) from rel)))::double / 15.0)))) as interaction_score
 from rel group by user_id, product_id""")

# ---------------------------------------------------------------- text
def text_clean_sql(x: str) -> str:
    e = f"lower({x})"
    for pat, rep in CONTRACTION_RULES:
        pat_sql = pat.replace("'", "''")
        rep_sql = rep.replace("$1", "\\1")
        e = f"regexp_replace({e}, '{pat_sql}', '{rep_sql}', 'g')"
    e = f"regexp_replace({e}, '\\p{{Nd}}+', '', 'g')"
    e = f"regexp_replace({e}, '[[:punct:]]', '', 'g')"
    e = f"regexp_replace({e}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"
    return (f"array_to_string(list_filter(string_split({e}, ' '), "
            f"lambda w: regexp_full_match(w, '[a-z]+')), ' ')")

# ---------------------------------------------------------------- analytics
cte("dist_prod", ["c_split"], """
 select * exclude (rn) from (select *, row_number() over (partition by product_id order by event_time,
   event_type nulls first, category_id nulls first, main_category nulls first, sub_category nulls first,
   brand nulls first, price nulls first, user_id nulls first, user_session nulls first) as rn from c_split)
 where rn = 1""")
cte("purch", ["clean"], "select * from clean where event_type = 'purchase'")
cte("pbb", ["clean"], """
 select product_id, category_id, main_category, sub_category, brand, avg(price) as product_avg_price
 from clean group by product_id, category_id, main_category, sub_category, brand""")

# ---------------------------------------------------------------- catalogue
cte("catalog_raw", [], """
 select concat('B', lpad(cast(p.p_partkey as varchar), 9, '0')) as product_id,
  case when p.p_partkey % 20 = 0 then concat('bundle ', p.p_partkey - p.p_partkey % 100)
   else concat(p.p_name, ' ', p.p_brand, ' ', p.p_partkey) end as product_name, d.text as about_product,
  concat(case when p.p_size % 3 = 0 then 'Computers&Accessories' when p.p_size % 3 = 1 then 'Electronics'
   else 'HomeKitchen' end, '|', replace(p.p_type, ' ', ''), '|', p.p_name) as category,
  concat('₹', cast(p.p_partkey % 9 + 1 as varchar), ',', lpad(cast((p.p_partkey * 37) % 1000 as varchar), 3, '0')) as discounted_price,
  concat('₹', cast(p.p_partkey % 9 + 2 as varchar), ',', lpad(cast((p.p_partkey * 53) % 1000 as varchar), 3, '0'), '.50') as actual_price,
  concat(cast(p.p_size as varchar), '%') as discount_percentage,
  case when p.p_partkey % 31 = 0 then '|' when p.p_partkey % 29 = 0 then '5.0'
   else concat(cast(p.p_partkey % 4 + 1 as varchar), '.', cast(p.p_partkey % 10 as varchar)) end as rating,
  case when p.p_partkey % 43 = 0 then null else concat(cast(p.p_size as varchar), ',',
   lpad(cast((p.p_partkey * 7) % 1000 as varchar), 3, '0')) end as rating_count,
  case when p.p_partkey % 3 = 0 then concat('U', cast(p.p_partkey % 50 as varchar))
   else concat('U', cast(p.p_partkey % 50 as varchar), ',U', cast((p.p_partkey * 3) % 50 as varchar)) end as user_id,
  case when p.p_partkey % 3 = 0 and p.p_partkey % 5 = 0 then concat('N', cast(p.p_partkey % 50 as varchar), ',Jr')
   when p.p_partkey % 3 = 0 then concat('N', cast(p.p_partkey % 50 as varchar))
   else concat('N', cast(p.p_partkey % 50 as varchar), ',N', cast((p.p_partkey * 3) % 50 as varchar)) end as user_name,
  concat('http://img.example.com/', cast(p.p_partkey as varchar)) as img_link,
  concat('http://shop.example.com/dp/', cast(p.p_partkey as varchar)) as product_link
 from part p left join documents d on d.doc_id = p.p_partkey""")

cte("sentiment", [], """
 select concat('B', lpad(cast(p_partkey as varchar), 9, '0')) as product_id,
  (p_partkey % 7)::double / 20.0 as neg, (p_partkey % 11)::double / 20.0 as neu,
  1.0 - (p_partkey % 7)::double / 20.0 - (p_partkey % 11)::double / 20.0 as pos,
  1.0 - (p_partkey % 7)::double / 20.0 - (p_partkey % 11)::double / 20.0 - (p_partkey % 7)::double / 20.0 as compound
 from part""")


def number_taker_sql(x: str) -> str:
    return f"try_cast(nullif(array_to_string(regexp_extract_all({x}, '\\d+\\.\\d+|\\d+'), ''), '') as double)"


cte("cat_num", ["catalog_raw"], f"""
 select product_id, product_name, about_product, category,
  {number_taker_sql('discounted_price')} as discounted_price, {number_taker_sql('actual_price')} as actual_price,
  {number_taker_sql('discount_percentage')} / 100.0 as discount_percentage,
  {number_taker_sql('rating')} as rating, {number_taker_sql('rating_count')} as rating_count,
  user_id, user_name, img_link, product_link from (select distinct * from catalog_raw)""")
cte("cat_typed", ["cat_num"], """
 select * exclude (category, rating), coalesce(rating, 4.0) as rating,
  regexp_replace(string_split(category, '|')[1], '([A-Z&])', ' \\1', 'g') as category_1,
  regexp_replace(string_split(category, '|')[2], '([A-Z&])', ' \\1', 'g') as category_2
 from cat_num""")
cte("cat_banded", ["cat_typed"], """
 select *, case when rating < 2.0 then 'Poor' when rating < 3.0 then 'Below Average' when rating < 4.0 then 'Average'
   when rating < 5.0 then 'Above Average' when rating = 5.0 then 'Excellent' end as rating_score,
  actual_price - discounted_price as price_difference
 from cat_typed
 where coalesce((length(user_id) - length(replace(user_id, ',', ''))) - (length(user_name) - length(replace(user_name, ',', ''))) <> -1, true)""")
cte("cat_rows", ["cat_banded"], """
 select * exclude (user_id, user_name), unnest(string_split(user_id, ',')) as user_id,
  unnest(string_split(user_name, ',')) as user_name from cat_banded""")
cte("cat_final", ["cat_rows", "sentiment"], """
 select r.product_id, product_name, about_product, category_1, category_2, discounted_price, actual_price,
  discount_percentage, price_difference, rating, rating_count, rating_score, s.neg, s.neu, s.pos, s.compound,
  user_id, user_name, img_link, product_link
 from cat_rows r left join (select distinct * from sentiment) s on r.product_id = s.product_id""")
cte("cat_products", ["cat_rows"], """
 select product_id, product_name, about_product, category_1, category_2, discounted_price, actual_price,
  discount_percentage, rating, rating_count, img_link, product_link from (
  select *, row_number() over (partition by product_name order by product_id, about_product, category_1 nulls first,
    category_2 nulls first, discounted_price nulls first, actual_price nulls first, discount_percentage nulls first,
    rating nulls first, rating_count nulls first, img_link, product_link) as rn
  from (select distinct product_id, product_name, about_product, category_1, category_2, discounted_price,
    actual_price, discount_percentage, rating, rating_count, img_link, product_link from cat_rows)) where rn = 1""")

# ---------------------------------------------------------------- search
cte("docs", ["cat_products"], f"""
 select *, {text_clean_sql("concat_ws(' ', product_name, about_product, category_1, category_2)")} as description
 from cat_products""")
cte("bank", ["docs"], """
 select word, count(*) as freq from (select unnest(string_split(description, ' ')) as word from docs)
 where length(word) > 0 group by word""")
cte("tf", ["docs"], """
 select product_id, term, count(*) as tf from (select product_id,
  unnest(list_filter(string_split(description, ' '), lambda w: length(w) >= 2)) as term from docs) group by all""")
cte("idf", ["tf", "docs"], """
 select term, count(*) as df, ln((1 + (select count(*) from docs)) / (1 + count(*))) + 1 as idf
 from tf group by term""")
cte("idx", ["tf", "idf"], """
 select product_id, term, tf, w / sqrt(sum(w * w) over (partition by product_id)) as weight
 from (select tf.product_id, tf.term, tf.tf, tf.tf * idf.idf as w from tf join idf on tf.term = idf.term)""")
cte("qs", [], """
 select * from (values (1, 'the worthless'), (2, 'tha ering'), (3, 'wrthless'), (4, 'zzzz')) as v(query_id, text)
 union all select 1000 + p_partkey, concat_ws(' ', lower(p_name), nullif(regexp_extract(lower(text), '[a-z]{6,}'), ''))
 from part left join documents on doc_id = p_partkey""")
cte("qwords", ["qs"], """
 select query_id, unnest(ws) as word, unnest(range(len(ws))) as pos from
 (select query_id, list_filter(string_split_regex(trim(lower(text)), '\\s+'), lambda w: length(w) > 0) as ws from qs)""")
cte("fixw", ["qwords", "bank"], """
 with uw as (select distinct word from qwords),
 cand as (select u.word, b.word as cand, levenshtein(u.word, b.word) as dist, b.freq from uw u join bank b
   on levenshtein(u.word, b.word) <= 2 where u.word not in (select word from bank)),
 best as (select word, cand as corrected from (select *, row_number() over (partition by word
   order by dist, freq desc, cand) as rn from cand) where rn = 1)
 select word, word as corrected from uw where word in (select word from bank)
 union all select uw.word, best.corrected from uw left join best on uw.word = best.word
 where uw.word not in (select word from bank)""")
cte("corr", ["qs", "qwords", "fixw"], """
 select q.query_id, lower(q.text) as query,
  coalesce(case when count(*) filter (where f.corrected is null) > 0 then ''
   else string_agg(f.corrected, ' ' order by w.pos) end, '') as corrected
 from qs q left join qwords w on q.query_id = w.query_id left join fixw f on w.word = f.word
 group by q.query_id, lower(q.text)""")
def _query_vectors_sql(asked: str = "") -> str:
    return f"""
 select query_id, term, w / sqrt(sum(w * w) over (partition by query_id)) as qweight from
 (select query_id, term, tf * idf as w from (select query_id, term, count(*) as tf from
   (select query_id, unnest(regexp_extract_all(lower(corrected), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from corr{asked})
   group by all) t join idf using (term))"""


def _ranked_sql(vectors: str) -> str:
    return f"""
 select *, row_number() over (partition by query_id order by round(similarity, 10) desc, product_id) as rank
 from (select query_id, product_id, sum(qweight * weight) as similarity from {vectors} join idx using (term) group by all)"""


# the whole query set, and the literal queries with those of the parts divisible by 100
cte("qv_all", ["corr", "idf"], _query_vectors_sql())
cte("ranked_all", ["qv_all", "idx"], _ranked_sql("qv_all"))
cte("qv", ["corr", "idf"], _query_vectors_sql("\n    where query_id < 1000 or query_id % 100 = 0"))
cte("ranked", ["qv", "idx"], _ranked_sql("qv"))


def stem_sql(x: str) -> str:
    """The stem of ``x``: one nested select per step, so that each is evaluated once."""
    from shoplens.functions.stem import STEPS, patterns
    w = x
    for step in STEPS:
        cases = " ".join(f"when regexp_matches(w, '{p}') then regexp_replace(w, '{p}', '\\1{new}')" for p, new in patterns(step))
        w = f"(select case {cases} else w end from (select {w} as w))"
    return f"case when regexp_matches({x}, '^[a-z]{{3,}}$') then {w} else {x} end"


cte("lemmas", ["bank"], f"""
 select token, stem, first_value(token) over (partition by stem order by freq desc, token) as lemma
 from (select word as token, freq, {stem_sql('word')} as stem from bank)""")
cte("near_lemmas", ["docs", "lemmas"], """
 with t as (select list_filter(string_split(description, ' '), lambda w: length(w) > 0) as ws from docs),
 p as (select ws[i] as a, ws[i + d] as b from (select ws, d, unnest(range(1, len(ws) - d + 1)) as i
   from t, (values (1), (2)) as v(d)))
 select least(x.lemma, y.lemma) as x, greatest(x.lemma, y.lemma) as y, count(*) as n
 from p join lemmas x on p.a = x.token join lemmas y on p.b = y.token group by all""")
cte("synonyms", ["near_lemmas"], """
 with s as (select x, y, n from near_lemmas union all select y, x, n from near_lemmas where x <> y),
 own as (select x, sum(n) as own from s group by x)
 select x as lemma, y as synonym from (
  select s.x, s.y, row_number() over (partition by s.x order by s.n::double / b.own::double desc, s.n desc, s.y) as r
  from s join own a on s.x = a.x join own b on s.y = b.x
  where s.x <> s.y and s.n >= 5 and s.n * (select sum(n)::double from near_lemmas) > a.own * b.own::double)
 where r <= 2""")

# ---------------------------------------------------------------- recommendation
_M = 2147483647


def mix_hash_sql(*cols: str, seed: int = 42) -> str:
    m = f"cast({_M} as bigint)"

    def pm(e):
        return f"((({e}) % {m}) + {m}) % {m}"
    h = f"cast({seed % _M} as bigint)"
    for c in cols:
        x = pm(f"cast({c} as bigint)")
        h = pm(f"({pm(f'({h}) * 48271')} + {x}) * 48271")
        h = pm(f"({h}) * 16807")
    return h


cte("emb_users", [], "select vec_id as user_id, embedding from embeddings where vec_id % 10 = 0")
cte("emb_products", [], "select vec_id as product_id, embedding from embeddings where vec_id % 10 <> 0")
cte("emb_seen", ["emb_users", "emb_products"], """
 select u.user_id, p.product_id from emb_products p join emb_users u on u.user_id = p.product_id - p.product_id % 10""")

cte("emb_scored", ["emb_users", "emb_products"], """
 select u.user_id, p.product_id, list_cosine_similarity(u.embedding::double[], p.embedding::double[]) as score
 from emb_users u join emb_products p on list_inner_product(u.embedding::double[], u.embedding::double[]) > 0
  and list_inner_product(p.embedding::double[], p.embedding::double[]) > 0""")
cte("emb_topn", ["emb_scored", "emb_seen"], """
 select user_id, product_id, score, rank from (select *, row_number() over (partition by user_id
   order by round(score, 10) desc, product_id) as rank from emb_scored s
  where not exists (select 1 from emb_seen e where e.user_id = s.user_id and e.product_id = s.product_id))
 where rank <= 10""")
cte("routing", ["clean", "emb_users"], """
 select u.user_id, coalesce(n.interactions, 0) as interactions,
  case when coalesce(n.interactions, 0) <= 0 then 0 when n.interactions < 100 then 2 else 8 end as slots
 from (select c_custkey as user_id from customer union select user_id from clean union select user_id from emb_users) u
 left join (select user_id, count(*) as interactions from clean group by user_id) n on u.user_id = n.user_id""")

# ---------------------------------------------------------------- per-file cleaning
cte("c_canon_day", ["c_split"], """
 select product_id, cast(event_time as date) as d, first(brand order by event_time, brand) as canonical_brand
 from c_split where brand is not null and brand <> '' and lower(brand) <> 'nan'
 group by product_id, cast(event_time as date)""")
cte("c_brand_day", ["c_split", "c_canon_day"], """
 select s.event_time, s.event_type, s.product_id, s.category_id, s.main_category, s.sub_category,
  coalesce(c.canonical_brand, s.brand) as brand, s.price, s.user_id, s.user_session
 from c_split s left join c_canon_day c on s.product_id = c.product_id and cast(s.event_time as date) = c.d""")
cte("clean_day", ["c_brand_day"], """
 select cast(event_time as date) as date, cast(isodow(event_time) - 1 as integer) as weekday,
  strftime(event_time, '%H:%M:%S') as time, event_type, product_id, category_id, main_category,
  sub_category, brand, price, user_id, user_session from (
 select event_time, event_type, product_id, category_id, main_category, sub_category, brand, price, user_id, user_session
 from (select *, row_number() over (partition by event_type, product_id, user_id, user_session
        order by event_time, category_id nulls first, main_category nulls first, sub_category nulls first,
                 brand nulls first, price nulls first) as rn
       from c_brand_day where event_type in ('cart', 'remove_from_cart')) where rn = 1
 union all
 select * from c_brand_day where event_type is null or event_type not in ('cart', 'remove_from_cart'))""")
