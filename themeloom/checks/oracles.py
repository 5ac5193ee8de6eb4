"""SQL with the meaning of each registered query, written on its own terms."""

from __future__ import annotations

import re


def _row(pick: str) -> str:
    """The picked row of the normalised matrix."""
    return f"""select u.term_id as j, sum(p.cnt * (u.cnt - (u.term_id = p.term_id)::int) * u.w) / any_value(s) as v
        from usable p join usable u using (doc_id) join row_sum on row_sum.term_id = p.term_id
        where p.term_id = (select i from {pick}) group by u.term_id"""


def _product(vector: str, entry: str, name: str) -> str:
    """Products of all rows of the normalised matrix with a vector over the terms j."""
    return f"""select u.term_id as i, sum(u.w * u.cnt * (t - coalesce({entry}, 0))) / any_value(s) as {name}
        from usable u join (select doc_id, sum(cnt * {entry}) as t from usable join {vector} on j = term_id group by doc_id) using (doc_id)
        left join {vector} on j = u.term_id join row_sum on row_sum.term_id = u.term_id group by u.term_id"""


# Named parts, in the order in which they may refer to each other.
PARTS: dict[str, str] = {
    "lines": "select doc_id, unnest(string_split(text, chr(10))) as line from documents",
    "spaced": """select doc_id, unnest(case when line = '' then [''] when rtrim(line, ' ') = '' then []
        else string_split(rtrim(line, ' '), ' ') end) as word from lines""",
    "tok": r"select doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as term from documents",
    "terms": "select doc_id, term, count(*) as cnt from tok group by doc_id, term",
    "words": """select term, df, total, row_number() over (order by df desc, term) - 1 as term_id
        from (select term, count(*) as df, sum(cnt) as total from terms group by term)""",
    "trip_all": "select doc_id, term_id, cnt from terms join words using (term)",
    "len_all": "select doc_id, sum(cnt) as n from trip_all group by doc_id",
    "sum_all": """select term_id, sum(cnt::double / n) as s from trip_all join len_all using (doc_id)
        where n >= 2 group by term_id""",
    "sum_foreign": """select term_id, sum(cnt::double / n) as s from trip_all join len_all using (doc_id)
        join documents using (doc_id) where n >= 2 and lang <> 'en' group by term_id""",
    "trip": "select doc_id, term_id, cnt::double as cnt from trip_all",
    "len": "select doc_id, sum(cnt) as n from trip group by doc_id",
    "aspect_of": """select d.doc_id, coalesce(l.quality + 1, 0) as aspect
        from documents d left join labels l using (doc_id)""",
    "cov": """select doc_id, lang, (lang = 'de')::int::double as x1, (lang = 'en')::int::double as x2,
        (lang = 'es')::int::double as x3,
        (ln(1 + n_chars) - avg(ln(1 + n_chars)) over ()) / stddev_pop(ln(1 + n_chars)) over () as z
        from documents""",
    # Co-occurrences: cells are added up where they are summarised, the whole matrix is not kept.
    "usable": "select doc_id, term_id, cnt, 1 / (n * (n - 1)) as w from trip join len using (doc_id) where n >= 2",
    "profile": """select i, count(*) as cells, sum(q) as s, sum(q * q) as r from (
        select a.term_id as i, sum(a.cnt * (b.cnt - (a.term_id = b.term_id)::int) * a.w) as q
        from usable a join usable b using (doc_id) group by a.term_id, b.term_id having q <> 0) group by i""",
    "row_sum": """select term_id, sum(cnt / n) as s from trip join len using (doc_id)
        where n >= 2 group by term_id""",
    "norms": "select i, r / (row_sum.s * row_sum.s) as r from profile join row_sum on i = term_id",
    # Three anchors by orthogonal directions. A row comes from the documents that hold its term, a product with
    # a vector from one inner product per document.
    "pick1": "select i, r from norms order by round(r, 12) desc, i limit 1",
    "row1": _row("pick1"),
    "dir1": "select j, v / sqrt((select sum(v * v) from row1)) as b from row1",
    "in1": _product("dir1", "b", "c"),
    "left1": """select i, r - coalesce(c, 0) * coalesce(c, 0) as r from norms left join in1 using (i)
        where i not in (select i from pick1)""",
    "pick2": "select i, r from left1 order by round(r, 12) desc, i limit 1",
    "plain2": _row("pick2"),
    "row2": """select j, coalesce(q, 0) - coalesce((select c from in1 where i = (select i from pick2)), 0) * coalesce(b, 0) as v
        from (select j, v as q from plain2) full join dir1 using (j)""",
    "dir2": "select j, v / sqrt((select sum(v * v) from row2)) as b from row2",
    "in2": _product("dir2", "b", "c"),
    "left2": """select i, r - coalesce(c, 0) * coalesce(c, 0) as r from left1 left join in2 using (i)
        where i not in (select i from pick2)""",
    "pick3": "select i, r from left2 order by round(r, 12) desc, i limit 1",
    "anch": """select 1 as rank, i as term_id from pick1 union all select 2, i from pick2
        union all select 3, i from pick3""",
    "plain3": _row("pick3"),
    "prod0": _product("row1", "v", "v"),
    "prod1": _product("plain2", "v", "v"),
    "prod2": _product("plain3", "v", "v"),
    "prod": """select t.i as term_id, k.k, coalesce(p.v, 0) as v from norms t cross join (select unnest(range(3)) as k) k
        left join (select 0 as k, i, v from prod0 union all select 1, i, v from prod1 union all select 2, i, v from prod2) p
        on p.i = t.i and p.k = k.k""",
    "crossed": "select a.rank - 1 as k1, p.k as k2, p.v from prod p join anch a using (term_id)",
    "target": """select term_id, sum(v) filter (k = 0) as y0, sum(v) filter (k = 1) as y1, sum(v) filter (k = 2) as y2
        from prod where term_id not in (select term_id from anch) group by term_id""",
    # Terms with the same products have the same weights: each is sought once.
    "aim": "select row_number() over () as aim_id, y0, y1, y2 from (select distinct y0, y1, y2 from target)",
    "xx": """select sum(v) filter (k1 = 0 and k2 = 0) as x00, sum(v) filter (k1 = 0 and k2 = 1) as x01,
        sum(v) filter (k1 = 0 and k2 = 2) as x02, sum(v) filter (k1 = 1 and k2 = 1) as x11,
        sum(v) filter (k1 = 1 and k2 = 2) as x12, sum(v) filter (k1 = 2 and k2 = 2) as x22 from crossed""",
    "climb": """select aim_id, 0 as it, 1e0 / 3 as w0, 1e0 / 3 as w1, 1e0 / 3 as w2, 200e0 as step,
            'infinity'::double as size, false as done from aim
        union all
        select aim_id, it + 1, case when taken then n0 else w0 end, case when taken then n1 else w1 end,
            case when taken then n2 else w2 end, case when taken then step else step / 2 end,
            case when taken then now else size end, taken and abs(size - now) < 1e-27
        from (
            select *, (n0 * (n0 * x00 + 2 * n1 * x01 + 2 * n2 * x02) + n1 * (n1 * x11 + 2 * n2 * x12) + n2 * n2 * x22) / 2
                    - (n0 * y0 + n1 * y1 + n2 * y2)
                <= (w0 * (w0 * x00 + 2 * w1 * x01 + 2 * w2 * x02) + w1 * (w1 * x11 + 2 * w2 * x12) + w2 * w2 * x22) / 2
                    - (w0 * y0 + w1 * y1 + w2 * y2) + 1e-16 as taken
            from (
                select *, u0 / (u0 + u1 + u2) as n0, u1 / (u0 + u1 + u2) as n1, u2 / (u0 + u1 + u2) as n2
                from (
                    select *, w0 * exp(step * g0 - m) as u0, w1 * exp(step * g1 - m) as u1, w2 * exp(step * g2 - m) as u2
                    from (
                        select *, sqrt(g0 * g0 + g1 * g1 + g2 * g2) as now, step * greatest(g0, g1, g2) as m
                        from (
                            select c.*, y0, y1, y2, x00, x01, x02, x11, x12, x22,
                                y0 - (w0 * x00 + w1 * x01 + w2 * x02) as g0,
                                y1 - (w0 * x01 + w1 * x11 + w2 * x12) as g1,
                                y2 - (w0 * x02 + w1 * x12 + w2 * x22) as g2
                            from climb c join aim using (aim_id) cross join xx
                            where it < 499 and not done)))))""",
    "settled": """select term_id, w0, w1, w2 from target join aim using (y0, y1, y2) join (
            select aim_id, arg_max(w0, it) as w0, arg_max(w1, it) as w1, arg_max(w2, it) as w2 from climb group by aim_id) using (aim_id)""",
    "weight": """select term_id, 0 as topic, w0 as weight from settled union all select term_id, 1, w1 from settled
        union all select term_id, 2, w2 from settled union all
        select a.term_id, k.rank - 1, (a.rank = k.rank)::int::double from anch a, anch k""",
    "probs": "select term_id, total / (select sum(total) from words)::double as p from words",
    "recovered": """select topic, term_id, weight * p / sum(weight * p) over (partition by topic) as prob
        from weight join probs using (term_id)""",
    # Given parameters.
    "count4": """select lang, term_id, sum(cnt) as c from trip join documents using (doc_id) group by lang, term_id""",
    "langs": """select lang, row_number() over (order by lang) - 1 as topic from (select distinct lang from documents)""",
    "topic4": """select topic, v.term_id, (coalesce(c, 0) + 1e-2) / (sum(coalesce(c, 0)) over (partition by topic) + 1e-2 * (select count(*) from words)) as prob
        from langs cross join words v left join count4 on count4.lang = langs.lang and count4.term_id = v.term_id""",
    "eta4": """select doc_id, 0 as k, 8e-1 * x1 - 2e-1 + 1e-1 * z as eta, 5e-1 * x1 as mu from cov
        union all select doc_id, 1, 8e-1 * x2 - 2e-1 + 2e-1 * z, 5e-1 * x2 from cov
        union all select doc_id, 2, 8e-1 * x3 - 2e-1 + 3e-1 * z, 5e-1 * x3 from cov""",
    "theta4": """select doc_id, topic, exp(eta) / sum(exp(eta)) over (partition by doc_id) as theta
        from (select doc_id, k as topic, eta from eta4 union all select doc_id, 3, 0e0 from documents)""",
    "share4": """select doc_id, term_id, cnt, topic, theta * prob as part,
        sum(theta * prob) over (partition by doc_id, term_id) as word
        from trip join topic4 using (term_id) join theta4 using (doc_id, topic)""",
    "phi4": """select aspect, topic, term_id, sum(cnt * part / word) as value from share4
        join aspect_of using (doc_id) group by aspect, topic, term_id""",
    "beta4": """select topic, term_id, sum(value) / sum(sum(value)) over (partition by topic) as prob
        from phi4 group by topic, term_id""",
    "fit4": """select doc_id, sum(cnt * ln(word)) as likelihood from share4 where topic = 0 group by doc_id""",
    "prior4": """select doc_id, (2e-2 * sum((eta - mu) * (eta - mu)) + 5e-3 * sum(eta - mu) * sum(eta - mu)) as prior
        from eta4 group by doc_id""",
    "count_of4": "select doc_id, topic, sum(cnt * part / word) as s from share4 group by doc_id, topic",
    # Three topics: English, German, the rest.
    "count3": """select term_id, sum(cnt) filter (lang = 'en') as c0, sum(cnt) filter (lang = 'de') as c1,
        sum(cnt) filter (lang not in ('en', 'de')) as c2
        from trip join documents using (doc_id) group by term_id""",
    "topic3": """select term_id,
        (coalesce(c0, 0) + 1e-2) / (sum(c0) over () + 1e-2 * count(*) over ()) as b0,
        (coalesce(c1, 0) + 1e-2) / (sum(c1) over () + 1e-2 * count(*) over ()) as b1,
        (coalesce(c2, 0) + 1e-2) / (sum(c2) over () + 1e-2 * count(*) over ()) as b2 from count3""",
    "doc3": "select doc_id, 5e-1 * x2 as m0, 1e-1 * z as m1 from cov",
    "trip3": "select doc_id, term_id, cnt, b0, b1, b2 from trip join topic3 using (term_id)",
    "new_tok": r"select item_id as doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as term from benchmark",
    "new_doc": "select item_id as doc_id, 0e0 as m0, 0e0 as m1 from benchmark",
    "new_trip": """select doc_id, term_id, count(*)::double as cnt, any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2
        from new_tok join words using (term) join topic3 using (term_id) group by doc_id, term_id""",
}


def _search(name: str, docs: str, trip: str, prior: str) -> dict[str, str]:
    """Best logits of each document for three topics: rounds that bound the curvature from
    above and so cannot overshoot far, then Newton rounds. ``docs`` gives the prior mean
    (m0, m1), ``prior`` in one row the precision (p00, p01, p11) and half the log of the
    covariance's determinant."""
    sums = f"""select e.doc_id, e.e0, e.e1, {{extra}} coalesce(sum(cnt), 0) as n,
            coalesce(sum(cnt * q0), 0) as s0, coalesce(sum(cnt * q1), 0) as s1,
            coalesce(sum(cnt * q0 * q0), 0) as s00, coalesce(sum(cnt * q0 * q1), 0) as s01,
            coalesce(sum(cnt * q1 * q1), 0) as s11, coalesce(sum(cnt * ln(word)), 0) as fit
            from (select e.*, cnt,
                exp(e0) / (1 + exp(e0) + exp(e1)) as t0, exp(e1) / (1 + exp(e0) + exp(e1)) as t1,
                (b0 * exp(e0) + b1 * exp(e1) + b2) / (1 + exp(e0) + exp(e1)) as word,
                b0 * exp(e0) / (b0 * exp(e0) + b1 * exp(e1) + b2) as q0,
                b1 * exp(e1) / (b0 * exp(e0) + b1 * exp(e1) + b2) as q1
                from {{source}} e left join {trip} t on t.doc_id = e.doc_id) e
            group by {{group}}"""
    step = sums.format(extra="any_value(t0) as t0, any_value(t1) as t1, e.it,", source=f"{name}_walk", group="e.doc_id, e.it, e.e0, e.e1")
    step = step.replace("t.doc_id = e.doc_id) e", "t.doc_id = e.doc_id where e.it < 120) e")
    last = sums.format(extra="any_value(t0) as t0, any_value(t1) as t1,", source=f"(select doc_id, e0, e1 from {name}_walk where it = 120)", group="e.doc_id, e.e0, e.e1")
    return {
        f"{name}_walk": f"""select doc_id, 0 as it, 0e0 as e0, 0e0 as e1 from {docs}
            union all
            select doc_id, it + 1, e0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), e1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
            from (
                select s.doc_id, it, e0, e1,
                    p00 * (e0 - m0) + p01 * (e1 - m1) - (s0 - n * t0) as g0,
                    p01 * (e0 - m0) + p11 * (e1 - m1) - (s1 - n * t1) as g1,
                    p00 + n * t0 * (1 - t0) - case when it >= 100 then s0 - s00 else 0 end as h00,
                    p11 + n * t1 * (1 - t1) - case when it >= 100 then s1 - s11 else 0 end as h11,
                    p01 - n * t0 * t1 + case when it >= 100 then s01 else 0 end as h01
                from ({step}) s join {docs} using (doc_id) cross join {prior})""",
        f"{name}": f"""select doc_id, e0, e1, t0, t1, fit, h00, h11, h01, h00 * h11 - h01 * h01 as det, entropy,
                (p00 * (e0 - m0) * (e0 - m0) + p11 * (e1 - m1) * (e1 - m1)) / 2 + p01 * (e0 - m0) * (e1 - m1) as away
            from (
                select s.*, m0, m1, p00, p01, p11, entropy, p00 + n * t0 * (1 - t0) - s0 + s00 as h00,
                    p11 + n * t1 * (1 - t1) - s1 + s11 as h11, p01 - n * t0 * t1 + s01 as h01
                from ({last}) s join {docs} using (doc_id) cross join {prior})""",
        f"{name}_bound": f"""select doc_id, fit - ln(det) / 2 - away - entropy as bound from {name}""",
    }


def _counts(trip: str, best: str) -> str:
    """Expected counts of the three topics per term."""
    return f"""select term_id, sum(cnt * b0 * t0 / w) as c0, sum(cnt * b1 * t1 / w) as c1, sum(cnt * b2 * (1 - t0 - t1) / w) as c2
        from (select *, b0 * t0 + b1 * t1 + b2 * (1 - t0 - t1) as w from {trip} join {best} using (doc_id)) group by term_id"""


def _normalised(counts: str) -> str:
    return f"""select term_id, c0 / sum(c0) over () as b0, c1 / sum(c1) over () as b1, c2 / sum(c2) over () as b2 from {counts}"""


def _moments(best: str) -> str:
    """Mean of the logits, and their scatter around it plus posterior covariances, per document."""
    return f"""select m0, m1, avg((e0 - m0) * (e0 - m0) + h11 / det) as s00, avg((e0 - m0) * (e1 - m1) - h01 / det) as s01,
        avg((e1 - m1) * (e1 - m1) + h00 / det) as s11
        from {best} cross join (select avg(e0) as m0, avg(e1) as m1 from {best}) group by m0, m1"""


def _inverse(covariance: str) -> str:
    return f"""select s11 / (s00 * s11 - s01 * s01) as p00, -s01 / (s00 * s11 - s01 * s01) as p01,
        s00 / (s00 * s11 - s01 * s01) as p11, ln(s00 * s11 - s01 * s01) / 2 as entropy from {covariance}"""


LEVELS = (1, 2, 3)  # indicators x1 to x3; never two in a document


def _sum(text: str) -> str:
    return " + ".join(f"({text.format(l=l)})" for l in LEVELS)


def _each(text: str) -> str:
    return ", ".join(text.format(l=l) for l in LEVELS)


def _ridge(name: str, logits: str) -> dict[str, str]:
    """Regression of ``logits`` (doc_id, k, eta) on the intercept, the indicators and the length. The indicators are
    eliminated, which leaves two unknowns: v00, v01 and v11 are the inverse of their matrix."""
    return {
        f"{name}_sum": f"""select k, count(*)::double as n, sum(z) as sz, sum(z * z) as szz, sum(eta) as sy, sum(z * eta) as szy,
            sum(eta * eta) as syy, {_each("sum(x{l}) as n{l}, sum(x{l} * z) as z{l}, sum(x{l} * eta) as y{l}")}
            from {logits} join cov using (doc_id) group by k""",
        f"{name}_step": f"""select k, 0 as it, 0e0 as w0, 0e0 as wz, {_each("0e0 as w{l}")}, 5e0 as ea, 1e0 as ba, 1e0 as pr, 1e3 as moved from {name}_sum
            union all
            select k, it + 1, u0, uz, {_each("u{l}")}, 5 / (4 / (ea + 1) + uz * uz + v11 + {_sum("u{l} * u{l} + v{l}")}),
                1 / (npr + 1), npr, abs(u0 - w0) + abs(uz - wz) + {_sum("abs(u{l} - w{l})")}
            from (
                select *, ((1 + n) / 2) / ((syy - 2 * (u0 * sy + uz * szy + {_sum("u{l} * y{l}")})
                    + u0 * u0 * n + uz * uz * szz + 2 * u0 * uz * sz + {_sum("u{l} * (u{l} * n{l} + 2 * u0 * n{l} + 2 * uz * z{l})")}
                    + (5 - ea * (v11 + {_sum("v{l}")})) / pr) / 2 + ba) as npr
                from (
                    select *, {_each("(pr * y{l} - pr * n{l} * u0 - pr * z{l} * uz) / d{l} as u{l}")},
                        {_each("1 / d{l} + pr * pr * (n{l} * n{l} * v00 + 2 * n{l} * z{l} * v01 + z{l} * z{l} * v11) / (d{l} * d{l}) as v{l}")}
                    from (
                        select *, v00 * r0 + v01 * rz as u0, v01 * r0 + v11 * rz as uz
                        from (
                            select *, s11 / (s00 * s11 - s01 * s01) as v00, -s01 / (s00 * s11 - s01 * s01) as v01, s00 / (s00 * s11 - s01 * s01) as v11
                            from (
                                select *, pr * n - ({_sum("pr * n{l} * pr * n{l} / d{l}")}) as s00,
                                    pr * sz - ({_sum("pr * n{l} * pr * z{l} / d{l}")}) as s01,
                                    ea + pr * szz - ({_sum("pr * z{l} * pr * z{l} / d{l}")}) as s11,
                                    pr * sy - ({_sum("pr * n{l} * pr * y{l} / d{l}")}) as r0,
                                    pr * szy - ({_sum("pr * z{l} * pr * y{l} / d{l}")}) as rz
                                from (select r.*, s.* exclude (k), {_each("ea + pr * n{l} as d{l}")}
                                    from {name}_step r join {name}_sum s using (k) where moved > 1e-4))))))""",
        f"{name}_coef": f"""select k, arg_max(w0, it) as w0, arg_max(wz, it) as wz, {_each("arg_max(w{l}, it) as w{l}")} from {name}_step group by k""",
        f"{name}_mean": f"""select doc_id, k, w0 + wz * z + {_sum("w{l} * x{l}")} as mu from cov cross join {name}_coef""",
    }


PARTS |= _ridge("four", "eta4")
PARTS["prior3"] = "select 5e-2 as p00, 1e-2 as p01, 5e-2 as p11, -ln(24e-4) / 2 as entropy"
PARTS |= _search("best3", "doc3", "trip3", "prior3")
PARTS |= _search("best_new", "new_doc", "new_trip", "prior3")

# Two iterations of the fit: variance 20 and mean 0 at first, then what the first one gives.
PARTS |= {
    "em1_prior": "select 5e-2 as p00, 0e0 as p01, 5e-2 as p11, ln(400) / 2 as entropy",
    "em1_doc": "select doc_id, 0e0 as m0, 0e0 as m1 from documents",
}
PARTS |= _search("em1", "em1_doc", "trip3", "em1_prior")
PARTS |= {
    "em1_count": _counts("trip3", "em1"),
    "em1_topic": _normalised("em1_count"),
    "em1_moment": _moments("em1"),
    "em2_prior": _inverse("em1_moment"),
    "em2_doc": "select doc_id, m0, m1 from documents cross join em1_moment",
    "em2_trip": "select doc_id, term_id, cnt, b0, b1, b2 from trip join em1_topic using (term_id)",
}
PARTS |= _search("em2", "em2_doc", "em2_trip", "em2_prior")
PARTS |= {
    "em2_count": _counts("em2_trip", "em2"),
    "em2_topic": _normalised("em2_count"),
    "em2_moment": _moments("em2"),
}
# The same with all covariates: prior means follow from the coefficients.
for before, now in (("em1", "cm1"), ("cm2", "cm2")):
    if now == "cm2":
        PARTS |= {
            "cm2_doc": """select doc_id, max(mu) filter (k = 0) as m0, max(mu) filter (k = 1) as m1 from cm1_mean group by doc_id""",
            "cm2_prior": _inverse("cm1_moment"),
        }
        PARTS |= _search("cm2", "cm2_doc", "em2_trip", "cm2_prior")
    PARTS[f"{now}_eta"] = f"select doc_id, 0 as k, e0 as eta from {before} union all select doc_id, 1, e1 from {before}"
    PARTS |= _ridge(now, f"{now}_eta")
    PARTS[f"{now}_moment"] = f"""select avg((e0 - m0) * (e0 - m0) + h11 / det) as s00, avg((e0 - m0) * (e1 - m1) - h01 / det) as s01,
        avg((e1 - m1) * (e1 - m1) + h00 / det) as s11
        from {before} join (select doc_id, max(mu) filter (k = 0) as m0, max(mu) filter (k = 1) as m1 from {now}_mean group by doc_id) using (doc_id)"""
PARTS |= {
    "cm2_count": _counts("em2_trip", "cm2"),
    "cm2_topic": _normalised("cm2_count"),
}
PARTS |= {
    "nu3": """select doc_id, 0 as k1, 0 as k2, h11 / det as value from best3
        union all select doc_id, 0, 1, -h01 / det from best3 union all select doc_id, 1, 0, -h01 / det from best3
        union all select doc_id, 1, 1, h00 / det from best3""",
    "phi3": """select aspect, term_id, sum(cnt * b0 * t0 / w) as c0, sum(cnt * b1 * t1 / w) as c1,
        sum(cnt * b2 * (1 - t0 - t1) / w) as c2
        from (select *, b0 * t0 + b1 * t1 + b2 * (1 - t0 - t1) as w from trip3 join best3 using (doc_id))
        join aspect_of using (doc_id) group by aspect, term_id""",
    "both4": """select doc_id, 0 as i, 1e0 as v from cov union all select doc_id, 1, x1 from cov
        union all select doc_id, 2, x2 from cov union all select doc_id, 3, x3 from cov
        union all select doc_id, 4, z from cov union all select doc_id, 5 + k, eta from eta4""",
    "steps": "select unnest(range(1, 9)) as iteration",
    "path4": """select doc_id, iteration, topic, exp(eta * iteration / 8) / sum(exp(eta * iteration / 8)) over (partition by doc_id, iteration) as theta
        from (select doc_id, k as topic, eta from eta4 union all select doc_id, 3, 0e0 from documents) cross join steps""",
    "story": """select aspect as run, iteration, sum(cnt * ln(word)) as bound
        from (select doc_id, iteration, term_id, any_value(cnt) as cnt, sum(theta * prob) as word
            from trip join topic4 using (term_id) join path4 using (doc_id, topic)
            group by doc_id, iteration, term_id)
        join aspect_of using (doc_id) group by aspect, iteration""",
}

M = "round({} * 1e6, 4)"  # in millionths
# Lengths of rows are often short binary fractions, which lie on the border of decimal rounding: in units of 7e-6.
S = "round({} * 1e6 / 7, 4)"

FINAL: dict[str, str] = {
    "s1_triplets_nested": """select doc_id, count(*) as n_terms, min(term_id) as first_term, sum(cnt)::bigint as total
        from trip_all group by doc_id""",
    "s2_lines": "select line from lines",
    "s3_matrix": f"select topic as i, term_id as j, {M.format('prob')} as value from topic4",
    "s4_saved_counts": "select word, count(*) as cnt from spaced group by word",
    "s5_distribute": """select d.doc_id, aspect::bigint as aspect, coalesce(sum(cnt), 0)::bigint as n,
        count(t.term_id) as n_terms, coalesce(min(t.term_id), -1) as first_term
        from aspect_of d left join trip t using (doc_id) group by d.doc_id, aspect""",
    "c1_tokens": "select doc_id, word, count(*) as cnt from spaced group by doc_id, word",
    "c2_word_count": "select word, count(*) as cnt from spaced group by word",
    "c3_doc_term": "select doc_id, term_id, cnt from trip_all",
    "c4_terms_per_doc": "select doc_id, count(*) as n from trip_all group by doc_id",
    "c5_term_totals": "select term_id, sum(cnt)::bigint as total from trip_all group by term_id",
    "c6_word_prob": f"select term_id, {M.format('total / (select sum(total) from words)::double')} as prob from words",
    "c7_doc_length": "select doc_id, n::bigint as n from len_all",
    "c8_min_length_docs": "select doc_id, n::bigint as n from len_all where n >= 2",
    "c9_zero_terms": """select term_id from words w where not exists (
        select 1 from sum_foreign s where s.term_id = w.term_id)""",
    "c10_kept_terms": "select term_id from words join sum_foreign using (term_id)",
    "c11_drop_terms": """select term_id, total::bigint as total from words
        join sum_foreign using (term_id)""",
    "c11_drop_cells": f"""with kept as (select term_id from words join sum_foreign using (term_id) where df >= 2)
        select i, count(*) as cells, {M.format('sum(q)')} as s from (
            select a.term_id as i, sum(a.cnt * (b.cnt - (a.term_id = b.term_id)::int) * a.w) as q
            from usable a join usable b using (doc_id)
            where a.term_id in (select term_id from kept) and b.term_id in (select term_id from kept)
            group by a.term_id, b.term_id having q <> 0) group by i""",
    "c12_dimensions": """select (select count(*) from documents) as documents, (select count(*) from words) as terms,
        (select sum(cnt) from trip)::bigint as tokens""",
    "g1_gram": f"select i, cells, {M.format('s')} as s, {S.format('r')} as r from profile",
    "g2_gram_row_sums": "select term_id, round(s, 6) as s from sum_all",
    "g3_gram_normalised": f"""select i, cells, {M.format('profile.s / row_sum.s')} as s, {S.format('r / (row_sum.s * row_sum.s)')} as r
        from profile join row_sum on i = term_id""",
    "a1_row_norms": f"select i, {S.format('r')} as r from norms",
    "a2_argmax_row": f"select i, {S.format('r')} as r from pick1",
    "a3_anchors": "select rank::bigint as rank, term_id from anch",
    "r1_anchor_cross": f"select k1::bigint as k1, k2::bigint as k2, {M.format('v')} as v from crossed",
    "r2_row_by_anchor": f"select term_id, k::bigint as k, {M.format('v')} as v from prod",
    "r3_weights": "select term_id, topic::bigint as topic, round(weight, 6) as weight from weight",
    "r4_anchor_one_hot": """select v.term_id, k.rank::bigint - 1 as topic,
        round(case when a.rank is null then 1e0 / 3 when a.rank = k.rank then 1e0 else 0e0 end, 6) as weight
        from words v cross join anch k left join anch a on a.term_id = v.term_id""",
    "r5_recover_topics": f"select topic::bigint as topic, term_id, {M.format('prob')} as prob from recovered",
    "r6_refill": f"""select topic::bigint as topic, term_id, prob > 0 and prob < 1e-300 as is_floor, {M.format('prob')} as prob
        from (select topic, term_id, p / sum(p) over (partition by topic) as prob
            from (select k.topic, w.term_id, coalesce(r.prob, 5e-324) as p
                from words w cross join (select distinct topic from recovered) k
                left join recovered r on r.term_id = w.term_id and r.topic = k.topic))""",
    "i1_initial_state": "select doc_id, unnest(range(3)) as k, 0e0 as eta, 0e0 as mu from documents",
    "i1_topics_per_aspect": f"""select a.aspect, topic, term_id, {M.format('prob')} as prob
        from topic4 cross join (select unnest(range(3)) as aspect) a""",
    "i2_initialise": f"""select k.topic::bigint as topic, w.term_id, {M.format('coalesce(r.prob, 0)')} as prob
        from words w cross join (select distinct topic from recovered) k
        left join recovered r on r.term_id = w.term_id and r.topic = k.topic""",
    "e1_param_lookup": """select doc_id, aspect::bigint as aspect, k::bigint as k, round(eta, 6) as eta, round(mu, 6) as mu
        from eta4 join aspect_of using (doc_id)""",
    "e2_topic_slice": f"""select doc_id, term_id, cnt::bigint as cnt, topic, {M.format('prob')} as prob
        from trip join topic4 using (term_id)""",
    "e3_theta": "select doc_id, topic::bigint as topic, round(theta, 6) as theta from theta4",
    "e4_objective": """select doc_id, round(coalesce(likelihood, 0), 4) as likelihood, round(prior, 6) as prior,
        round(prior - coalesce(likelihood, 0), 4) as value from prior4 left join fit4 using (doc_id)""",
    "e5_gradient": """select e.doc_id, e.k::bigint as k,
        round(4e-2 * (eta - mu) + 1e-2 * sum(eta - mu) over (partition by e.doc_id) - coalesce(s, 0) + coalesce(n, 0) * theta, 6) as value
        from eta4 e join theta4 t on t.doc_id = e.doc_id and t.topic = e.k
        left join count_of4 c on c.doc_id = e.doc_id and c.topic = e.k left join len on len.doc_id = e.doc_id""",
    "e6_map_eta": """select doc_id, 0::bigint as k, round(e0, 5) as eta from best3
        union all select doc_id, 1, round(e1, 5) from best3""",
    "e7_phi": """select topic, term_id, round(sum(value), 5) as value from phi4 group by topic, term_id""",
    "e8_hessian": """with pairs as (
            select a.doc_id, a.topic as k1, b.topic as k2, sum(a.cnt * a.part * b.part / (a.word * a.word)) as s
            from share4 a join share4 b on b.doc_id = a.doc_id and b.term_id = a.term_id
            where a.topic < 3 and b.topic < 3 group by a.doc_id, a.topic, b.topic)
        select p.doc_id, k1, k2, round(p.s - n * t1.theta * t2.theta
            - case when k1 = k2 then c.s - n * t1.theta else 0 end + case when k1 = k2 then 5e-2 else 1e-2 end, 6) as value
        from pairs p join len using (doc_id) join theta4 t1 on t1.doc_id = p.doc_id and t1.topic = k1
        join theta4 t2 on t2.doc_id = p.doc_id and t2.topic = k2
        join count_of4 c on c.doc_id = p.doc_id and c.topic = k1""",
    "e9_nu": "select doc_id, k1::bigint as k1, k2::bigint as k2, round(value, 5) as value from nu3",
    "e10_bound": "select doc_id, round(bound, 4) as bound from best3_bound",
    "e11_accumulate": """select 'phi' as kind, aspect::bigint as aspect, term_id as idx, k::bigint as at,
            round(case k when 0 then c0 when 1 then c1 else c2 end, 4) as value
            from phi3 cross join (select unnest(range(3)) as k)
        union all select 'nu', -1, k1, k2, round(sum(value), 4) from nu3 group by k1, k2""",
    "b1_nu_sum": "select k1::bigint as i, k2::bigint as j, round(sum(value), 4) as v from nu3 group by k1, k2",
    "b2_stack_eta": """select doc_id, 0::bigint as k, round(e0, 5) as eta from best3
        union all select doc_id, 1, round(e1, 5) from best3""",
    "b3_total_bound": "select count(*) as documents, round(sum(bound), 2) as bound from best3_bound",
    "b4_phi_by_aspect": "select aspect::bigint as aspect, topic, term_id, round(value, 5) as value from phi4",
    "m1_suffstats": """select a.i::bigint as i, b.i::bigint as j, round(sum(a.v * b.v), 4) as v
        from both4 a join both4 b using (doc_id) group by a.i, b.i""",
    "m1_vbreg": """select k::bigint as topic, 0::bigint as covariate, round(w0, 6) as coef from four_coef
        union all select k, 1, round(w1, 6) from four_coef union all select k, 2, round(w2, 6) from four_coef
        union all select k, 3, round(w3, 6) from four_coef union all select k, 4, round(wz, 6) from four_coef""",
    "m2_mu": "select doc_id, k::bigint as k, round(mu, 6) as mu from four_mean",
    "m3_sigma": """with off as (select doc_id, e0 - m0 as d0, e1 - m1 as d1 from best3 join doc3 using (doc_id)),
        cells as (select k1, k2, value from nu3 union all select 0, 0, d0 * d0 from off union all select 0, 1, d0 * d1 from off
            union all select 1, 0, d0 * d1 from off union all select 1, 1, d1 * d1 from off)
        select k1::bigint as i, k2::bigint as j,
            round(case when k1 = k2 then 1e0 else 7e-1 end * sum(value) / (select count(*) from documents), 6) as v
        from cells group by k1, k2""",
    "m4_beta": f"select topic, term_id, {M.format('prob')} as prob from beta4",
    "f1_convergence": """with told as (
            select *, (bound - lag(bound) over w) / abs(lag(bound) over w) as gain from story window w as (partition by run order by iteration))
        select run::bigint as run, iteration, round(bound, 2) as bound, round(gain, 6) as gain, coalesce(gain < 1e-2, false) as converged,
            coalesce(gain < 1e-2, false) or iteration >= 7 as stop from told""",
    "p1_top_words": f"""select topic, rank, term_id, term, {M.format('prob')} as prob
        from (select *, row_number() over (partition by topic order by prob desc, term_id) as rank from topic4)
        join words using (term_id) where rank <= 5""",
    "p2_l1": """select round(sum(abs(a.prob)), 6) as size_a, round(sum(abs(b.prob)), 6) as size_b,
        round(sum(abs(a.prob - b.prob)), 6) as difference from topic4 a join beta4 b using (topic, term_id)""",
    "p3_anchor_compare": """select a.rank::bigint as rank, a.term_id as a, n.i as b from anch a
        join (select i, row_number() over (order by round(r, 12) desc, i) as rank from norms) n using (rank)""",
    "p4_score": """select doc_id, round(e0, 5) as eta0, round(e1, 5) as eta1, round(1 - t0 - t1, 6) as theta2, round(bound, 4) as bound
        from best_new join best_new_bound using (doc_id)""",
    "f2_two_iterations": f"""select topic::bigint as topic, term_id, {M.format('prob')} as prob
        from (select 0 as topic, term_id, b0 as prob from em2_topic union all select 1, term_id, b1 from em2_topic
            union all select 2, term_id, b2 from em2_topic)""",
    "f2_bounds": """select what, i::bigint as i, j::bigint as j, round(value, 3) as value from (
        select 'bound' as what, 1 as i, 0 as j, sum(bound) as value from em1_bound
        union all select 'bound', 2, 0, sum(bound) from em2_bound
        union all select 'mean', 0, 0, m0 from em2_moment union all select 'mean', 0, 1, m1 from em2_moment
        union all select 'covariance', 0, 0, s00 from em2_moment union all select 'covariance', 0, 1, s01 from em2_moment
        union all select 'covariance', 1, 0, s01 from em2_moment union all select 'covariance', 1, 1, s11 from em2_moment)""",
    "f2_covariate_topics": f"""select topic::bigint as topic, term_id, {M.format('prob')} as prob
        from (select 0 as topic, term_id, b0 as prob from cm2_topic union all select 1, term_id, b1 from cm2_topic
            union all select 2, term_id, b2 from cm2_topic)""",
    "f2_covariates": """select what, i::bigint as i, j::bigint as j, round(value, 3) as value from (
        select 'bound' as what, 1 as i, 0 as j, sum(bound) as value from em1_bound
        union all select 'bound', 2, 0, sum(bound) from cm2_bound
        union all select 'coefficient', 0, k, w0 from cm2_coef union all select 'coefficient', 1, k, w1 from cm2_coef
        union all select 'coefficient', 2, k, w2 from cm2_coef union all select 'coefficient', 3, k, w3 from cm2_coef
        union all select 'coefficient', 4, k, wz from cm2_coef
        union all select 'covariance', 0, 0, s00 from cm2_moment union all select 'covariance', 0, 1, s01 from cm2_moment
        union all select 'covariance', 1, 0, s01 from cm2_moment union all select 'covariance', 1, 1, s11 from cm2_moment
        union all select 'unsettled', 1, 0, 0 union all select 'unsettled', 2, 0, 0)""",
    "p5_output": """select 'doc_topics' as table_name, count(*) as rows from documents
        union all select 'prior_mean', count(*) from documents
        union all select 'topics', count(*) from words union all select 'vocabulary', count(*) from words
        union all select 'gamma', 15 union all select 'sigma', 9 union all select 'history', 2""",
}


def _needed(text: str) -> set[str]:
    found: set[str] = set()
    open_names = [n for n in PARTS if re.search(rf"\b{n}\b", text)]
    while open_names:
        name = open_names.pop()
        if name not in found:
            found.add(name)
            open_names += [n for n in PARTS if n != name and re.search(rf"\b{n}\b", PARTS[name])]
    return found


def statement(name: str) -> str:
    """The full SQL of one query: the parts it needs, then its own select."""
    text = FINAL[name]
    needed = _needed(text)
    parts = [f"{n} as materialized ({PARTS[n]})" if not _recursive(n) else f"{n} as ({PARTS[n]})" for n in PARTS if n in needed]
    own = re.match(r"\s*with\s+", text)
    if own:
        return f"with recursive {', '.join(parts)}, {text[own.end():]}"
    return f"with recursive {', '.join(parts)} {text}" if parts else text


def _recursive(name: str) -> bool:
    return bool(re.search(rf"\b{name}\b", PARTS[name]))


# The same results by topics that are joined to blocks of documents.
FINAL |= {f"{name}_blocks": FINAL[name] for name in ("e6_map_eta", "e11_accumulate")}

ORACLES: dict[str, str] = {name: statement(name) for name in FINAL}
