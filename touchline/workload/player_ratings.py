"""Queries over match rows of players: careers, roles, ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import adapters
from touchline.operators import players as P
from touchline.operators import skill as S
from touchline.plans.rating import leaderboard
from touchline.session import materialize
from touchline.workload.registry import query

PLAYER_MATCH_SQL = """
pm0 AS (
  SELECT l_orderkey // 8 AS match_id, CAST(l_suppkey % 2 + 1 AS INTEGER) AS team, l_suppkey AS player,
    CAST(sum(l_quantity * 20) AS BIGINT) AS samples,
    round(avg(floor(l_extendedprice / 100)) - 200, 6) AS average_x,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity * 10 ELSE 0 END) AS BIGINT) AS nearest_ball_samples,
    CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity * 5 ELSE 0 END) AS BIGINT) AS close_ball_samples,
    CAST(sum(l_linenumber * 3) AS BIGINT) AS input_events, CAST(sum(l_linenumber) AS BIGINT) AS kick_events,
    CAST(coalesce(sum(l_linenumber) FILTER (l_tax > 0.04), 0) AS BIGINT) AS kick_pressed_inputs,
    CAST(sum(l_linenumber * 2) AS BIGINT) AS touches,
    CAST(coalesce(sum(l_linenumber) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS self_retouches,
    CAST(coalesce(sum(l_linenumber) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS team_touch_transfers_out,
    CAST(coalesce(sum(l_linenumber) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS turnovers,
    CAST(coalesce(sum(l_linenumber) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS recoveries,
    CAST(coalesce(sum(l_linenumber) FILTER (l_discount > 0.045), 0) AS BIGINT) AS pressured_transitions,
    CAST(coalesce(sum(l_linenumber) FILTER (l_discount > 0.045 AND l_returnflag <> 'N'), 0) AS BIGINT) AS retained_under_pressure,
    CAST(sum(l_linenumber) AS BIGINT) AS touch_progression_events,
    sum(floor(l_extendedprice / 100) % 97 - 40) / 4 AS touch_progression_sum,
    count(*) FILTER (l_tax > 0.075) AS touch_goals,
    count(*) FILTER (l_tax > 0.065 AND l_tax < 0.075) AS touch_assists
  FROM lineitem GROUP BY ALL
),
pm AS (
  SELECT *, CASE WHEN match_id % 5 = 0 THEN 3 ELSE 4 END AS schema_version, (match_id % 10) * 1200 + 1200 AS total_frames,
    CASE WHEN player % 4 = 0 THEN 'auth:a' || player ELSE 'name:player ' || player END AS player_id,
    CASE WHEN match_id % 3 = 0 THEN 'player ' || player ELSE 'Player ' || player END AS name
  FROM pm0
)
"""

CAREER_SQL = """
names AS (
  SELECT player_id, arg_min(name, (-n, name)) AS name
  FROM (SELECT player_id, name, count(*) AS n FROM pm GROUP BY ALL) GROUP BY ALL
),
career AS (
  SELECT player_id, count(DISTINCT match_id) AS matches, sum(samples) AS samples,
    sum(nearest_ball_samples) AS nearest_ball_samples, sum(close_ball_samples) AS close_ball_samples,
    sum(input_events) AS input_events, sum(kick_events) AS kick_events, sum(touches) AS touches,
    sum(self_retouches) AS self_retouches, sum(team_touch_transfers_out) AS team_touch_transfers_out,
    sum(turnovers) AS turnovers, sum(recoveries) AS recoveries, sum(pressured_transitions) AS pressured_transitions,
    sum(retained_under_pressure) AS retained_under_pressure, sum(touch_progression_events) AS tpe,
    sum(touch_progression_sum) AS tps, sum(touch_goals) AS touch_goals, sum(touch_assists) AS touch_assists
  FROM pm GROUP BY ALL
),
rates AS (
  SELECT *, samples / 600.0 AS active_minutes,
    100.0 * nearest_ball_samples / samples AS nearest_ball_pct, 100.0 * close_ball_samples / samples AS close_ball_pct,
    kick_events / (samples / 600.0) AS kicks_per_min, input_events / (samples / 600.0) AS inputs_per_min,
    touches / (samples / 600.0) AS touches_per_min,
    100.0 * (self_retouches + team_touch_transfers_out) / (self_retouches + team_touch_transfers_out + turnovers) AS touch_retention_pct,
    CASE WHEN pressured_transitions > 0 THEN 100.0 * retained_under_pressure / pressured_transitions ELSE 0 END AS pressured_retention_pct,
    tps / tpe AS touch_progression, recoveries / (samples / 600.0) AS recoveries_per_min,
    10.0 * (touch_goals + touch_assists) / (samples / 600.0) AS goal_contrib_per_10
  FROM career JOIN names USING (player_id)
),
scored AS (
  SELECT *, (0.5 * (kicks_per_min - avg(kicks_per_min) OVER ()) / stddev_pop(kicks_per_min) OVER ()
           + 0.3 * (close_ball_pct - avg(close_ball_pct) OVER ()) / stddev_pop(close_ball_pct) OVER ()
           + 0.2 * (nearest_ball_pct - avg(nearest_ball_pct) OVER ()) / stddev_pop(nearest_ball_pct) OVER ())
           * least(1.0, sqrt(matches / 30.0)) AS involvement_score
  FROM rates WHERE matches >= 20 AND active_minutes >= 30
)
"""


def _r(*names, digits=4):
    return [F.round(n, digits).alias(n) for n in names]


@query(
    "player_career_totals", "AGG-03 PRJ-06 PRJ-07",
    f"""WITH {PLAYER_MATCH_SQL}, {CAREER_SQL}
    SELECT player_id, name, matches, CAST(samples AS BIGINT) AS samples, CAST(kick_events AS BIGINT) AS kick_events,
      CAST(touches AS BIGINT) AS touches, CAST(self_retouches AS BIGINT) AS self_retouches,
      CAST(turnovers AS BIGINT) AS turnovers, CAST(recoveries AS BIGINT) AS recoveries,
      CAST(touch_goals AS BIGINT) AS touch_goals, CAST(touch_assists AS BIGINT) AS touch_assists,
      round(tps, 4) AS touch_progression_sum
    FROM career JOIN names USING (player_id)""",
)
def player_career_totals(spark, folder):
    return P.career_totals(adapters.player_match(spark, folder)).select(
        "player_id", "name", "matches", "samples", "kick_events", "touches", "self_retouches", "turnovers",
        "recoveries", "touch_goals", "touch_assists", *_r("touch_progression_sum", digits=4),
    )


RATES = [
    "active_minutes", "nearest_ball_pct", "close_ball_pct", "kicks_per_min", "inputs_per_min", "touches_per_min",
    "touch_retention_pct", "pressured_retention_pct", "touch_progression", "recoveries_per_min", "goal_contrib_per_10",
]


@query(
    "player_career_rates", "AGG-04",
    f"""WITH {PLAYER_MATCH_SQL}, {CAREER_SQL}
    SELECT player_id, {', '.join(f'round({c}, 4) AS {c}' for c in RATES)} FROM rates""",
)
def player_career_rates(spark, folder):
    return P.career_rates(P.career_totals(adapters.player_match(spark, folder))).select("player_id", *_r(*RATES))


@query(
    "player_involvement", "WIN-08 FLT-05",
    f"""WITH {PLAYER_MATCH_SQL}, {CAREER_SQL}
    SELECT player_id, matches, round(involvement_score, 4) AS involvement_score FROM scored""",
)
def player_involvement(spark, folder):
    rates = P.career_rates(P.career_totals(adapters.player_match(spark, folder)))
    return P.involvement(P.with_minimum(rates, 20, 30.0)).select("player_id", "matches", *_r("involvement_score"))


for _key, _column in P.SORT_KEYS.items():
    def _table(spark, folder, key=_key, column=_column):
        table = P.player_table(adapters.player_match(spark, folder), sort=key)
        shown = F.col(column) if column == "matches" else F.round(column, 4)
        return table.select("player_id", "name", shown.alias("sort_value"))

    _shown = _column if _column == "matches" else f"round({_column}, 4)"
    query(
        f"player_table_by_{_key.replace('-', '_')}", "TOP-02",
        f"""WITH {PLAYER_MATCH_SQL}, {CAREER_SQL}
        SELECT player_id, name, {_shown} AS sort_value FROM scored
        ORDER BY {_column} DESC, matches DESC, player_id LIMIT 25""",
    )(_table)


@query(
    "dashboard_player_list", "TOP-05",
    f"""WITH {PLAYER_MATCH_SQL}, {CAREER_SQL}
    SELECT player_id, name, matches, round(active_minutes, 4) AS active_minutes, round(touches_per_min, 4) AS touches_per_min
    FROM rates WHERE matches >= 5 AND active_minutes >= 5
    ORDER BY matches DESC, rates.active_minutes DESC, player_id LIMIT 150""",
)
def dashboard_player_list(spark, folder):
    return P.dashboard_players(adapters.player_match(spark, folder)).select(
        "player_id", "name", "matches", *_r("active_minutes", "touches_per_min")
    )


SKILL_SQL = """
placed AS (
  SELECT match_id, team, player, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY match_id, team) AS n
  FROM pm WHERE samples > 0
  WINDOW w AS (PARTITION BY match_id, team ORDER BY CASE WHEN team = 1 THEN average_x ELSE -average_x END, player)
),
roles AS (
  SELECT match_id, team, player,
    CASE WHEN player = 0 OR n < 3 THEN 'unknown' WHEN i / greatest(n - 1, 1) <= 0.33 THEN 'defender'
         WHEN i / greatest(n - 1, 1) >= 0.67 THEN 'forward' ELSE 'midfield' END AS role
  FROM placed
),
base AS (
  SELECT *, samples * 6 / 3600.0 AS minutes, total_frames / 3600.0 AS match_minutes,
    CASE WHEN schema_version = 4 THEN team_touch_transfers_out ELSE self_retouches END AS xfer,
    CASE WHEN schema_version = 4 THEN team_touch_transfers_out + self_retouches ELSE self_retouches END AS kept
  FROM pm JOIN roles USING (match_id, team, player)
),
evidence AS (
  SELECT match_id, team, player_id, name, role, minutes, match_minutes,
    CASE WHEN kept + turnovers >= 3 THEN kept / (kept + turnovers) END AS retention,
    CASE WHEN touch_progression_events >= 3 THEN touch_progression_sum / touch_progression_events END AS progression,
    CASE WHEN minutes >= 0.5 THEN touch_assists * 10.0 / minutes + xfer / minutes * 0.05 END AS creation,
    CASE WHEN minutes >= 0.5 THEN touch_goals * 10.0 / minutes END AS finishing,
    CASE WHEN minutes >= 0.5 THEN recoveries / minutes END AS defending,
    CASE WHEN samples >= 30 THEN nearest_ball_samples / samples END AS positioning,
    CASE WHEN schema_version = 4 THEN CASE WHEN pressured_transitions >= 3 THEN retained_under_pressure / pressured_transitions END
         ELSE CASE WHEN samples >= 30 THEN close_ball_samples / samples END END AS pressure_recovery,
    CASE WHEN minutes >= 0.5 THEN -turnovers / minutes END AS risk_management
  FROM base
),
long AS (
  UNPIVOT (SELECT match_id, team, player_id, role, minutes, retention, progression, creation, finishing, defending,
                  positioning, pressure_recovery, risk_management FROM evidence)
  ON retention, progression, creation, finishing, defending, positioning, pressure_recovery, risk_management
  INTO NAME dimension VALUE value
),
pop AS (SELECT role, dimension, value FROM long WHERE minutes >= 1
        UNION ALL SELECT '*', dimension, value FROM long WHERE minutes >= 1),
med AS (SELECT role, dimension, count(*) AS n, median(value) AS center, stddev_pop(value) AS sd FROM pop GROUP BY ALL),
mads AS (SELECT role, dimension, median(abs(value - center)) AS mad FROM pop JOIN med USING (role, dimension) GROUP BY ALL),
own AS (
  SELECT role, dimension, n, center,
    CASE WHEN 1.4826 * mad > 1e-9 THEN 1.4826 * mad WHEN sd > 1e-9 THEN sd ELSE 1.0 END AS scale
  FROM med JOIN mads USING (role, dimension)
),
norms AS (
  SELECT r.role, g.dimension, coalesce(l.center, g.center) AS center, coalesce(l.scale, g.scale) AS scale
  FROM (SELECT DISTINCT role FROM evidence) r CROSS JOIN (SELECT * FROM own WHERE role = '*') g
  LEFT JOIN (SELECT * FROM own WHERE role <> '*' AND n >= 30) l ON l.role = r.role AND l.dimension = g.dimension
),
zs AS (
  SELECT match_id, team, player_id, role, dimension, minutes,
         greatest(-3.0, least(3.0, (value - center) / scale)) AS z
  FROM long JOIN norms USING (role, dimension)
),
strength AS (
  SELECT player_id, greatest(-2.0, least(2.0, sum(v * w) / (sum(w) + 6.0))) AS strength
  FROM (SELECT match_id, team, player_id, avg(z) AS v, greatest(0.25, least(2.0, sqrt(any_value(minutes) / 3.0))) AS w
        FROM zs GROUP BY ALL) GROUP BY ALL
),
members AS (
  SELECT DISTINCT e.match_id, e.team, e.player_id, coalesce(s.strength, 0.0) AS strength
  FROM evidence e LEFT JOIN strength s USING (player_id)
),
ctx AS (
  SELECT m.match_id, m.team, m.player_id,
    greatest(-1.0, least(1.0, coalesce((SELECT avg(o.strength) FROM members o
       WHERE o.match_id = m.match_id AND o.team = m.team AND o.player_id <> m.player_id), 0.0) / 2)) AS mate,
    greatest(-1.0, least(1.0, coalesce((SELECT avg(o.strength) FROM members o
       WHERE o.match_id = m.match_id AND o.team = 3 - m.team), 0.0) / 2)) AS opp
  FROM members m
),
obs AS (
  SELECT e.player_id, e.match_id, e.team, e.role, e.name, e.minutes, c.mate, c.opp,
    greatest(0.15, least(1.0, e.match_minutes / 3.0)) * greatest(0.25, least(2.0, sqrt(e.minutes / 3.0))) AS w,
    greatest(-0.25, least(0.25, 0.1 * c.opp - 0.1 * c.mate)) AS adj
  FROM evidence e JOIN ctx c USING (match_id, team, player_id)
),
dims AS (
  SELECT player_id, dimension, round(sum((z + adj) * w) / (sum(w) + 8.0), 6) AS mean,
    round(1 / sqrt(sum(w) + 8.0), 6) AS uncertainty, round(sum(w), 6) AS effective_weight
  FROM zs JOIN obs USING (match_id, team, player_id) GROUP BY ALL
),
weights(dimension, dw) AS (VALUES ('retention', 0.18), ('progression', 0.14), ('creation', 0.14), ('finishing', 0.14),
  ('defending', 0.14), ('positioning', 0.08), ('pressure_recovery', 0.09), ('risk_management', 0.09)),
rated AS (
  SELECT player_id, sum(mean * dw) / sum(dw) AS overall_z, sum(uncertainty * dw) / sum(dw) AS doubt
  FROM dims JOIN (SELECT dimension, CAST(dw AS DOUBLE) AS dw FROM weights) USING (dimension)
  WHERE effective_weight > 0 GROUP BY ALL
),
board AS (
  SELECT r.player_id, s.name, s.matches, s.minutes, s.role, r.overall_z,
    greatest(20.0, least(80.0, 50 + 10 * r.overall_z)) AS rating, 10 * r.doubt AS rating_uncertainty, s.mate, s.opp
  FROM rated r JOIN (
    SELECT player_id, count(*) AS matches, sum(minutes) AS minutes, avg(mate) AS mate, avg(opp) AS opp,
      (SELECT arg_min(role, (-m, role)) FROM (SELECT role, sum(minutes) AS m FROM obs i WHERE i.player_id = o.player_id GROUP BY 1)) AS role,
      (SELECT arg_min(name, (-n, name)) FROM (SELECT name, count(*) AS n FROM obs i WHERE i.player_id = o.player_id GROUP BY 1)) AS name
    FROM obs o GROUP BY player_id) s USING (player_id)
)
"""
WITH_SKILL = f"WITH {PLAYER_MATCH_SQL}, {SKILL_SQL}"


@query(
    "match_roles", "WIN-07 PRJ-09",
    f"{WITH_SKILL} SELECT match_id, team, player, role FROM roles",
)
def match_roles(spark, folder):
    return S.infer_roles(adapters.player_match(spark, folder)).select("match_id", "team", "player", "role")


@query(
    "raw_skill_metrics", "PRJ-17 PRJ-18",
    f"""{WITH_SKILL} SELECT match_id, team, player_id, round(minutes, 6) AS minutes, {', '.join(f'round({d}, 9) AS {d}' for d in S.DIMENSIONS)},
      round(greatest(0.25, least(2.0, sqrt(minutes / 3.0))), 6) AS exposure,
      round(greatest(0.15, least(1.0, match_minutes / 3.0)), 6) AS quality FROM evidence""",
)
def raw_skill_metrics(spark, folder):
    return S.match_evidence(adapters.player_match(spark, folder)).select(
        "match_id", "team", "player_id", *_r("minutes", digits=6), *_r(*S.DIMENSIONS, digits=9),
        F.round(S.exposure(), 6).alias("exposure"), F.round(S.match_quality_weight(), 6).alias("quality"),
    )


@query(
    "skill_normalizers", "AGG-08",
    f"{WITH_SKILL} SELECT role, dimension, round(center, 6) AS center, round(scale, 6) AS scale FROM norms",
)
def skill_normalizers(spark, folder):
    evidence = S.match_evidence(adapters.player_match(spark, folder)).select("role", "minutes", *S.DIMENSIONS)
    return S.normalizers(materialize(evidence)).select(
        "role", "dimension", *_r("center", "scale", digits=6)
    )


def _normalized(spark, folder):
    evidence = materialize(S.match_evidence(adapters.player_match(spark, folder)))
    return S.normalize(evidence, materialize(S.normalizers(evidence).coalesce(1)))


@query(
    "match_contexts", "JON-10",
    f"{WITH_SKILL} SELECT match_id, team, player_id, round(mate, 5) AS teammate_context, round(opp, 5) AS opponent_context FROM ctx",
)
def match_contexts(spark, folder):
    rows = _normalized(spark, folder)
    return S.match_contexts(rows, S.player_strengths(rows)).select(
        "match_id", "team", "player_id", *_r("teammate_context", "opponent_context", digits=5)
    )


@query(
    "skill_estimates", "AGG-09",
    f"""{WITH_SKILL} SELECT player_id, dimension, mean, uncertainty, effective_weight FROM dims""",
)
def skill_estimates(spark, folder):
    rows = _normalized(spark, folder)
    seen = S.observations(rows, S.player_strengths(rows))
    wide = S.shrink(seen, prior_weight=S.RATING_PRIOR)
    stacked = ", ".join(f"'{d}', {d}.mean, {d}.uncertainty, {d}.effective_weight" for d in S.DIMENSIONS)
    long = wide.select(
        "player_id", F.expr(f"stack({len(S.DIMENSIONS)}, {stacked}) AS (dimension, mean, uncertainty, effective_weight)")
    )
    return long


# Weighted sums of values of six digits fall on the middle between two shown values; as decimals they round the same everywhere.
@query(
    "skill_leaderboard", "AGG-10 TOP-01",
    f"""{WITH_SKILL}, main AS (
      SELECT player_id, arg_min(role, (-m, role)) AS role
      FROM (SELECT player_id, role, round(sum(minutes), 6) AS m FROM obs GROUP BY ALL) GROUP BY ALL
    )
    SELECT player_id, name, matches, round(minutes, 4) AS minutes, main.role AS role,
      CAST(round(CAST(overall_z AS DECIMAL(18, 9)), 5) AS DOUBLE) AS overall_z,
      CAST(round(CAST(rating AS DECIMAL(18, 9)), 4) AS DOUBLE) AS rating,
      CAST(round(CAST(rating_uncertainty AS DECIMAL(18, 9)), 4) AS DOUBLE) AS rating_uncertainty,
      round(mate, 5) AS average_teammate_context, round(opp, 5) AS average_opponent_context
    FROM board JOIN main USING (player_id)""",
)
def skill_leaderboard(spark, folder):
    exact = lambda name, digits: F.round(F.col(name).cast("decimal(18,9)"), digits).cast("double").alias(name)
    return leaderboard(adapters.player_match(spark, folder)).select(
        "player_id", "name", "matches", *_r("minutes"), "role", exact("overall_z", 5), exact("rating", 4), exact("rating_uncertainty", 4),
        *_r("average_teammate_context", "average_opponent_context", digits=5),
    )


@query(
    "skill_top_players", "TOP-01 FLT-05",
    f"""{WITH_SKILL} SELECT player_id, name, role, round(rating, 4) AS rating, round(rating_uncertainty, 4) AS rating_uncertainty
    FROM board WHERE matches >= 20 AND minutes >= 60
    ORDER BY board.rating DESC, board.rating_uncertainty, matches DESC, player_id LIMIT 30""",
)
def skill_top_players(spark, folder):
    board = S.top_of_leaderboard(leaderboard(adapters.player_match(spark, folder)))
    return board.select("player_id", "name", "role", *_r("rating", "rating_uncertainty"))
