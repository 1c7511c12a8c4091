"""SQL texts that several query twins share.

Each twin is an independent formulation in plain SQL (joins on bin rows, window
ECDFs) of what the DataFrame operators compute.
"""

from __future__ import annotations

from collections.abc import Sequence

PROBS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


def comma(parts: Sequence[str]) -> str:
    return "".join(f"{p}, " for p in parts)


def long_sql(source: str, features: Sequence[str], kind: str, keys: Sequence[str] = ()) -> str:
    """UNION ALL of one SELECT per feature."""
    zero = " + 0.0" if kind == "DOUBLE" else ""
    return " UNION ALL ".join(
        f"SELECT {comma(keys)}'{f}' AS feature, CAST({f} AS {kind}){zero} AS value FROM {source}"
        for f in features
    )


def bins_sql(long: str = "ref_long") -> str:
    """CTEs ``edges`` and ``bins`` from the distinct deciles of ``long``."""
    return f"""
deciles AS (SELECT feature, unnest(quantile_cont(value, {PROBS})) AS e
            FROM {long} WHERE value IS NOT NULL GROUP BY feature),
distinct_edges AS (SELECT DISTINCT feature, e FROM deciles),
single AS (SELECT feature, min(e) AS v FROM distinct_edges GROUP BY feature HAVING count(*) = 1),
edges AS (SELECT d.feature, d.e FROM distinct_edges d ANTI JOIN single s ON s.feature = d.feature
          UNION ALL SELECT feature, v - 1 FROM single UNION ALL SELECT feature, v + 1 FROM single)"""


BINS_FROM_EDGES = """
edge_rows AS (SELECT feature, e AS low, lead(e) OVER w AS high,
                     row_number() OVER w - 1 AS bin,
                     count(*) OVER (PARTITION BY feature) - 1 AS k
              FROM edges WINDOW w AS (PARTITION BY feature ORDER BY e)),
bins AS (SELECT feature, bin, k, low, high,
                CASE WHEN bin = 0 THEN '-infinity'::DOUBLE ELSE low END AS lo,
                CASE WHEN bin = k - 1 THEN 'infinity'::DOUBLE ELSE high END AS hi
         FROM edge_rows WHERE high IS NOT NULL)"""


def histogram_sql(name: str, long: str, keys: Sequence[str] = ()) -> str:
    """CTEs ``<name>_n`` and ``<name>``: counts on the full grid of groups and bins."""
    k = comma(keys)
    on = "".join(f" AND g.{c} IS NOT DISTINCT FROM l.{c}" for c in keys)
    gk = "".join(f"g.{c}, " for c in keys)
    return f"""
{name}_n AS (SELECT {k}feature, count(value) AS n FROM {long} GROUP BY {k}feature),
{name} AS (SELECT {gk}g.feature, b.bin, b.k, b.low, b.high, g.n,
                  count(l.value) FILTER (WHERE l.value >= b.lo AND
                     (l.value < b.hi OR (b.bin = b.k - 1 AND l.value <= b.hi))) AS c
           FROM {name}_n g JOIN bins b ON b.feature = g.feature
           LEFT JOIN {long} l ON l.feature = g.feature{on}
           GROUP BY {gk}g.feature, b.bin, b.k, b.low, b.high, g.n)"""


def psi_terms_sql(keys: Sequence[str] = ()) -> str:
    """CTE ``terms``: per bin smoothed shares and the component."""
    ck = "".join(f"c.{x}, " for x in keys)
    return f"""
terms AS (SELECT {ck}c.feature, c.bin, c.k, c.low, c.high,
                 r.c AS rc, c.c AS cc, r.n AS rn, c.n AS cn,
                 CASE WHEN r.n > 0 AND c.n > 0 THEN
                   ((c.c + 1e-4) / (c.n + c.k * 1e-4) - (r.c + 1e-4) / (r.n + c.k * 1e-4))
                   * ln(((c.c + 1e-4) / (c.n + c.k * 1e-4)) / ((r.c + 1e-4) / (r.n + c.k * 1e-4)))
                 END AS comp
          FROM cur_h c JOIN ref_h r ON r.feature = c.feature AND r.bin = c.bin)"""


def psi_numerical_ctes(
    ref: str, cur: str, features: Sequence[str], keys: Sequence[str] = (), edges: str | None = None
) -> str:
    """All CTEs up to ``terms`` for numerical features of two sources."""
    return f"""
ref_long AS ({long_sql(ref, features, 'DOUBLE')}),
cur_long AS ({long_sql(cur, features, 'DOUBLE', keys)}),
{edges or bins_sql()},{BINS_FROM_EDGES},
{histogram_sql('ref_h', 'ref_long')},
{histogram_sql('cur_h', 'cur_long', keys)},{psi_terms_sql(keys)}"""


def psi_sum_sql(keys: Sequence[str] = ()) -> str:
    k = comma(keys)
    return f"""
psi_num AS (SELECT {k}feature, round(coalesce(sum(comp), 0.0), 5) + 0.0 AS psi,
               max(rn) AS ref_n, max(cn) AS cur_n, max(k) < 2 AS degenerate_bins
        FROM terms GROUP BY {k}feature)"""


def category_ctes(
    ref: str, cur: str, features: Sequence[str], keys: Sequence[str] = (), listed: str | None = None
) -> str:
    """CTEs up to ``cells``; ``listed`` is SQL giving (feature, category)."""
    k = comma(keys)
    gk = "".join(f"g.{x}, " for x in keys)
    same = "".join(f" AND c.{x} IS NOT DISTINCT FROM g.{x}" for x in keys)
    same_c = "".join(f" AND cc.{x} IS NOT DISTINCT FROM g.{x}" for x in keys)
    if listed is None:
        domain = f"""
domain AS (SELECT DISTINCT {gk}g.feature, c.value AS category FROM groups g
           JOIN (SELECT feature, value FROM ref_cat WHERE value IS NOT NULL) c
             ON c.feature = g.feature
           UNION
           SELECT DISTINCT {k}feature, value FROM cur_mapped WHERE value IS NOT NULL)"""
        mapped = f"SELECT {k}feature, value FROM cur_cat"
    else:
        domain = f"""
domain AS (SELECT DISTINCT {gk}g.feature, c.category FROM groups g JOIN listed c
             ON c.feature = g.feature
           UNION
           SELECT DISTINCT {k}feature, value FROM cur_mapped WHERE value IS NOT NULL)"""
        mapped = f"""SELECT {"".join(f"c.{x}, " for x in keys)}c.feature,
            CASE WHEN c.value IS NULL THEN NULL WHEN l.category IS NULL THEN '__OTHER__'
                 ELSE c.value END AS value
            FROM cur_cat c LEFT JOIN listed l ON l.feature = c.feature AND l.category = c.value"""
    listed_cte = f"listed AS ({listed})," if listed else ""
    ref_filter = (
        "AND rc.value <> '__OTHER__'" if listed else ""
    )
    return f"""
ref_cat AS ({long_sql(ref, features, 'VARCHAR')}),
cur_cat AS ({long_sql(cur, features, 'VARCHAR', keys)}),
{listed_cte}
cur_mapped AS ({mapped}),
groups AS (SELECT {k}feature, count(value) AS cur_n FROM cur_cat GROUP BY {k}feature),
ref_tot AS (SELECT feature, count(value) AS ref_n FROM ref_cat GROUP BY feature),
rcount AS (SELECT feature, value, count(*) AS c FROM ref_cat WHERE value IS NOT NULL
           GROUP BY feature, value),
ccount AS (SELECT {k}feature, value, count(*) AS c FROM cur_mapped WHERE value IS NOT NULL
           GROUP BY {k}feature, value),{domain},
cells AS (SELECT {gk}g.feature, g.category, coalesce(rc.c, 0) AS rc, coalesce(cc.c, 0) AS cc,
                 coalesce(t.ref_n, 0) AS rn, c.cur_n AS cn,
                 count(*) OVER (PARTITION BY {gk}g.feature) AS k
          FROM domain g JOIN groups c ON c.feature = g.feature{same}
          LEFT JOIN ref_tot t ON t.feature = g.feature
          LEFT JOIN rcount rc ON rc.feature = g.feature AND rc.value = g.category {ref_filter}
          LEFT JOIN ccount cc ON cc.feature = g.feature AND cc.value = g.category{same_c}),
cat_terms AS (SELECT *, CASE WHEN rn > 0 AND cn > 0 THEN
                ((cc + 1e-4) / (cn + k * 1e-4) - (rc + 1e-4) / (rn + k * 1e-4))
                * ln(((cc + 1e-4) / (cn + k * 1e-4)) / ((rc + 1e-4) / (rn + k * 1e-4))) END AS comp
              FROM cells)"""


def psi_cat_sum_sql(keys: Sequence[str] = ()) -> str:
    k = comma(keys)
    return f"""
psi_cat AS (SELECT {k}feature, round(coalesce(sum(comp), 0.0), 5) + 0.0 AS psi,
               max(rn) AS ref_n, max(cn) AS cur_n, max(k) < 2 AS degenerate_bins
        FROM cat_terms GROUP BY {k}feature)"""


def ks_ctes(keys: Sequence[str] = ()) -> str:
    """CTE ``ks``: statistic over ``ref_long`` and ``cur_long`` by plain window ECDFs."""
    k = comma(keys)
    gk = "".join(f"g.{x}, " for x in keys)
    on = "".join(f" AND c.{x} IS NOT DISTINCT FROM g.{x}" for x in keys)
    return f"""
ks_g AS (SELECT {k}feature, count(value) AS cur_n FROM cur_long GROUP BY {k}feature),
ks_r AS (SELECT feature, count(value) AS ref_n FROM ref_long GROUP BY feature),
ks_points AS (
  SELECT {gk}g.feature, r.value, count(*) AS r, 0 AS c FROM ks_g g
    JOIN ref_long r ON r.feature = g.feature WHERE r.value IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT {k}feature, value, 0, count(*) FROM cur_long WHERE value IS NOT NULL GROUP BY ALL),
ks_merged AS (SELECT {k}feature, value, sum(r) AS r, sum(c) AS c FROM ks_points GROUP BY ALL),
ks_cum AS (SELECT {k}feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc FROM ks_merged
           WINDOW w AS (PARTITION BY {k}feature ORDER BY value)),
ks AS (SELECT {gk}g.feature, g.cur_n, r.ref_n,
              round(CASE WHEN g.cur_n > 0 AND r.ref_n > 0 THEN
                max(abs(c.cr / r.ref_n - c.cc / g.cur_n)) ELSE 0.0 END, 5) + 0.0 AS ks_statistic
       FROM ks_g g JOIN ks_r r ON r.feature = g.feature
       LEFT JOIN ks_cum c ON c.feature = g.feature{on}
       GROUP BY {gk}g.feature, g.cur_n, r.ref_n)"""


CHI2 = """
chi_cells AS (SELECT *, rc + 1.0::DOUBLE AS r1, cc + 1.0::DOUBLE AS c1 FROM cells),
chi_tot AS (SELECT *, sum(r1) OVER f AS rt, sum(c1) OVER f AS ct FROM chi_cells
            WINDOW f AS (PARTITION BY feature)),
chi_terms AS (SELECT feature, k, rn, cn, r1, c1, (r1 + c1) * rt / (rt + ct) AS er,
                     (r1 + c1) * ct / (rt + ct) AS ec FROM chi_tot),
chi_raw AS (SELECT feature, (CASE WHEN max(k) > 1 AND max(rn) > 0 AND max(cn) > 0 THEN sum(
            power(abs(r1 - er) - CASE WHEN k = 2 THEN least(0.5, abs(r1 - er)) ELSE 0 END, 2) / er
          + power(abs(c1 - ec) - CASE WHEN k = 2 THEN least(0.5, abs(c1 - ec)) ELSE 0 END, 2) / ec)
          ELSE 0.0 END) AS x, CAST(max(k) - 1 AS BIGINT) AS dof,
          max(rn) AS ref_n, max(cn) AS cur_n
         FROM chi_terms GROUP BY feature),
chi2 AS (SELECT feature, round(x, 4) + 0.0 AS chi2_statistic, dof, ref_n, cur_n FROM chi_raw)"""

# The survival function is a finite sum for an even number of degrees of freedom.
CHI2_P = """
chi2_p AS (SELECT chi2.*, round(list_sum([exp(-x / 2) * power(x / 2, j) / factorial(j::INT)
                                          for j in range(chi2.dof // 2)]), 6) + 0.0 AS chi2_p_value
           FROM chi2 JOIN chi_raw USING (feature) WHERE chi2.dof % 2 = 0)"""

STATUS = "CASE WHEN psi >= 0.20 THEN 'DRIFT' WHEN psi >= 0.10 THEN 'WARNING' ELSE 'STABLE' END"
