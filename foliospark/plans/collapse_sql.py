"""Checking SQL for the repeat collapsing rules, which need back-references a linear-time regular
expression engine does not have.

The rule "a unit of L characters repeated at least c times in a row becomes three copies" is
restated without patterns. For a line s and a length L, the positions where s[i] differs from
s[i + L] cut the line into stretches; a stretch of at least (c - 1) * L equal positions is a run.
The replacement is then replayed from left to right: take the leftmost place where a run can
start, there the longest unit, skip all its whole copies, go on behind them.
"""

from __future__ import annotations


def _pass(name: str, lines: str, units: str, copies: int) -> str:
    """CTEs ``{name}(s, t)``: the rewritten form of each distinct line of ``lines(s)``."""
    need = copies - 1
    return f"""
{name}_chars AS (SELECT s, len(s) AS n, list_transform(string_split(s, ''), lambda c: unicode(c)) AS ch
  FROM (SELECT DISTINCT s FROM {lines}) WHERE len(s) >= {2 * copies if copies == 5 else copies}),
{name}_units AS (SELECT s, n, ch, list_filter({units}, lambda u: len(list_filter(
    range(0, CAST(floor(n / u) AS BIGINT) - {need - 1}), lambda m: {' AND '.join(
      f'ch[(m + {k}) * u + 1] = ch[(m + {k + 1}) * u + 1]' for k in range(min(need - 1, 3)))})) > 0) AS us
  FROM {name}_chars),
{name}_cuts AS (SELECT s, n, us, list_transform(us, lambda u: list_concat([0], list_filter(
    range(1, n - u + 1), lambda i: ch[i] <> ch[i + u]), [n - u + 1])) AS cuts
  FROM {name}_units WHERE len(us) > 0),
{name}_each AS (SELECT s, unnest(us) AS u, unnest(cuts) AS bp FROM {name}_cuts),
{name}_runs AS (SELECT s, u, bp[k] + 1 AS a, bp[k + 1] - bp[k] - 1 AS run
  FROM (SELECT s, u, bp, unnest(range(1, len(bp))) AS k FROM {name}_each)
  WHERE bp[k + 1] - bp[k] - 1 >= {need} * u),
{name}_play AS (
  SELECT DISTINCT s, CAST(1 AS BIGINT) AS pos, '' AS done FROM {name}_runs
  UNION ALL
  SELECT s, best.p + best.u + CAST(floor((best.e - best.p) / best.u) AS BIGINT) * best.u,
         done || substr(s, pos, best.p - pos) || repeat(substr(s, best.p, best.u), 3)
  FROM (SELECT y.s, y.pos, y.done, arg_min(
          {{'p': greatest(r.a, y.pos), 'u': r.u, 'e': r.a + r.run}},
          greatest(r.a, y.pos) * 1000000 - r.u) AS best
        FROM {name}_play y JOIN {name}_runs r ON r.s = y.s
         AND greatest(r.a, y.pos) <= r.a + r.run - {need} * r.u
        GROUP BY y.s, y.pos, y.done)),
{name} AS (SELECT s, arg_max(done || substr(s, pos), pos) AS t FROM {name}_play GROUP BY s)"""


def collapse_ctes(source: str, out: str = "collapsed") -> str:
    """CTEs from ``source(id, txt)`` to ``out(id, txt)``: single-character runs of ten or more,
    then sequences of two or more characters repeated five or more times, line by line. The
    enclosing query must start WITH RECURSIVE."""
    return f"""
{out}_ln AS (SELECT id, unnest(string_split(txt, chr(10))) AS s,
  generate_subscripts(string_split(txt, chr(10)), 1) AS ln FROM {source}),
{_pass(out + '_c', out + '_ln', '[1]', 10)},
{out}_l2 AS (SELECT l.id, l.ln, coalesce(c.t, l.s) AS s FROM {out}_ln l LEFT JOIN {out}_c c USING (s)),
{_pass(out + '_q', out + '_l2', 'range(2, CAST(floor(n / 5) AS BIGINT) + 1)', 5)},
{out} AS (SELECT l.id, string_agg(coalesce(q.t, l.s), chr(10) ORDER BY l.ln) AS txt
  FROM {out}_l2 l LEFT JOIN {out}_q q USING (s) GROUP BY l.id)"""
