"""Queries over match events: touches, kicks, goals, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import adapters
from touchline.operators import touches as T
from touchline.workload.registry import query

EVENTS_SQL = """
ev AS (
  SELECT strftime(ts, '%Y-%m-%d') AS replay, event_id AS seq, k,
         CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 30) AS INTEGER) AS frame,
         CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'contact'
              WHEN event_type = 'purchase' THEN 'kick'
              WHEN k < 25 THEN 'goal' WHEN k >= 90 THEN 'reset' ELSE 'input' END AS kind,
         user_id % 9 AS player,
         CASE WHEN user_id % 9 = 8 THEN 0 ELSE (user_id % 9) % 2 + 1 END AS team,
         round(value - 245, 2) AS ball_x, CAST(k - 50 AS DOUBLE) AS ball_y,
         CASE WHEN k < 90 THEN CAST(k AS DOUBLE) END AS pressure_distance,
         CASE WHEN event_type = 'error' AND k < 25 THEN event_id % 2 + 1 END AS goal_team,
         k % 3 - 1 AS dir_x, (k // 3) % 3 - 1 AS dir_y
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
),
seg AS (
  SELECT *, coalesce(max(CASE WHEN kind IN ('goal', 'reset') THEN seq END)
                     OVER (PARTITION BY replay ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS segment
  FROM ev
),
goals AS (SELECT * FROM seg WHERE kind = 'goal'),
contacts AS (
  SELECT *, lag(player) OVER w AS lp, lag(frame) OVER w AS lf
  FROM seg WHERE kind = 'contact' WINDOW w AS (PARTITION BY replay, segment ORDER BY seq)
),
touches0 AS (
  SELECT * FROM contacts WHERE team IN (1, 2) AND NOT coalesce(lp = player AND frame - lf <= 3, false)
),
touches AS (
  SELECT t.*, coalesce(t.pressure_distance <= 45, false) AS under_pressure,
         CASE WHEN np IS NULL THEN CASE WHEN g.goal_team = t.team AND g.frame - t.frame <= 300 THEN 4 ELSE 0 END
              WHEN np = t.player THEN 1 WHEN nt = t.team THEN 2 ELSE 3 END AS outcome,
         np AS next_player,
         CASE WHEN t.team = 1 THEN nx - t.ball_x ELSE t.ball_x - nx END AS progression
  FROM (SELECT *, lead(player) OVER w AS np, lead(team) OVER w AS nt, lead(ball_x) OVER w AS nx
        FROM touches0 WINDOW w AS (PARTITION BY replay, segment ORDER BY seq)) t
  LEFT JOIN (SELECT replay, segment, goal_team, frame FROM goals) g USING (replay, segment)
),
kicks AS (
  SELECT *, lead(seq) OVER w AS next_kick, lag(player) OVER w AS pp, lag(team) OVER w AS pt, lag(ball_x) OVER w AS px
  FROM seg WHERE kind = 'kick' WINDOW w AS (PARTITION BY replay, segment ORDER BY seq)
),
settled AS (
  SELECT k.replay, k.seq, arg_min(t.player, t.seq) AS sp, arg_min(t.team, t.seq) AS st, arg_min(t.frame, t.seq) AS sf
  FROM kicks k JOIN touches0 t ON t.replay = k.replay AND t.segment = k.segment AND t.seq > k.seq
       AND t.seq < coalesce(k.next_kick, 9223372036854775807)
       AND (t.player <> k.player OR t.frame - k.frame > 3)
  GROUP BY ALL
),
kick_rows AS (
  SELECT k.*, coalesce(k.pressure_distance <= 45, false) AS under_pressure,
         CASE WHEN sp IS NULL THEN CASE WHEN k.next_kick IS NULL AND g.goal_team = k.team AND g.frame - k.frame <= 300
                                        THEN 4 ELSE 0 END
              WHEN sf - k.frame > 240 THEN 0 WHEN sp = k.player THEN 1 WHEN st = k.team THEN 2 ELSE 3 END AS outcome,
         CASE WHEN sf - k.frame <= 240 THEN sp END AS next_player,
         (pt IN (1, 2) AND team IN (1, 2)) IS TRUE AS linked
  FROM kicks k LEFT JOIN settled s USING (replay, seq)
  LEFT JOIN (SELECT replay, segment, goal_team, frame FROM goals) g USING (replay, segment)
)
"""


def _chain(spark, folder):
    return T.chain_events(adapters.events(spark, folder))


def _resolved(spark, folder):
    return T.resolve_chain(_chain(spark, folder))


def touch_rows(spark, folder):
    return T.touch_outcomes(_resolved(spark, folder))


def kick_rows(spark, folder):
    return T.kick_outcomes(_resolved(spark, folder))


def goal_rows(chain):
    return chain.filter(F.col("kind") == "goal").select("replay", "segment", "seq", "frame", "goal_team")


@query(
    "play_segments", "WIN-01",
    f"WITH {EVENTS_SQL} SELECT replay, segment, count(*) AS n_events, min(seq) AS first_seq FROM seg GROUP BY ALL",
)
def play_segments(spark, folder):
    return (
        T.play_segments(adapters.events(spark, folder))
        .groupBy("replay", "segment")
        .agg(F.count(F.lit(1)).alias("n_events"), F.min("seq").alias("first_seq"))
    )


@query(
    "debounced_touches", "WIN-02",
    f"WITH {EVENTS_SQL} SELECT replay, segment, seq, frame, player, team FROM touches0",
)
def debounced_touches(spark, folder):
    return _chain(spark, folder).filter("is_touch").select("replay", "segment", "seq", "frame", "player", "team")


@query(
    "touch_outcomes", "WIN-03 WIN-04 PRJ-09",
    f"""WITH {EVENTS_SQL}
    SELECT replay, seq, frame, player, team, ball_x, ball_y, pressure_distance,
           CAST(under_pressure AS INTEGER) AS under_pressure, outcome, next_player,
           round(progression, 4) AS progression FROM touches""",
)
def touch_outcomes(spark, folder):
    return touch_rows(spark, folder).select(
        "replay", "seq", "frame", "player", "team", "ball_x", "ball_y", "pressure_distance",
        F.col("under_pressure").cast("int").alias("under_pressure"), "outcome", "next_player",
        F.round("progression", 4).alias("progression"),
    )


@query(
    "kick_outcomes", "JON-15",
    f"WITH {EVENTS_SQL} SELECT replay, seq, frame, player, team, outcome, next_player FROM kick_rows",
)
def kick_outcomes(spark, folder):
    return kick_rows(spark, folder).select("replay", "seq", "frame", "player", "team", "outcome", "next_player")


@query(
    "kick_chains", "WIN-05",
    f"""WITH {EVENTS_SQL}
    SELECT replay, pp AS player, count(*) FILTER (pt = team) AS retained, count(*) FILTER (pt <> team) AS lost,
           round(coalesce(sum(CASE WHEN pt = team THEN CASE WHEN team = 1 THEN ball_x - px ELSE px - ball_x END END), 0), 4)
             AS progression_sum
    FROM kick_rows WHERE linked GROUP BY ALL""",
)
def kick_chains(spark, folder):
    kept = F.col("chain_retained")
    return (
        kick_rows(spark, folder)
        .filter(F.col("chain_player").isNotNull())
        .groupBy("replay", F.col("chain_player").alias("player"))
        .agg(
            F.count(F.when(kept, 1)).alias("retained"),
            F.count(F.when(~kept, 1)).alias("lost"),
            F.round(F.coalesce(F.sum("chain_progression"), F.lit(0.0)), 4).alias("progression_sum"),
        )
    )


@query(
    "collapsed_touch_runs", "WIN-06",
    f"""WITH {EVENTS_SQL} SELECT replay, segment, seq, player, team FROM touches
    WHERE next_player IS NULL OR next_player <> player""",
)
def collapsed_touch_runs(spark, folder):
    return T.collapsed_runs(touch_rows(spark, folder)).select("replay", "segment", "seq", "player", "team")


GOAL_CREDIT_SQL = """
runs AS (
  SELECT *, lead(seq) OVER w AS after, lag(player) OVER w AS bp, lag(team) OVER w AS bt, lag(frame) OVER w AS bf
  FROM (SELECT * FROM touches WHERE next_player IS NULL OR next_player <> player)
  WINDOW w AS (PARTITION BY replay, segment ORDER BY seq)
),
credits AS (
  SELECT g.replay, g.seq, g.frame, g.goal_team,
         CASE WHEN r.team = g.goal_team AND g.frame - r.frame <= 300 THEN r.player END AS scorer,
         CASE WHEN r.team = g.goal_team AND g.frame - r.frame <= 300
               AND r.bt = g.goal_team AND g.frame - r.bf <= 600 THEN r.bp END AS assist
  FROM goals g LEFT JOIN (SELECT * FROM runs WHERE after IS NULL) r USING (replay, segment)
)
"""


@query(
    "goal_touch_credits", "JON-16 WIN-06",
    f"WITH {EVENTS_SQL}, {GOAL_CREDIT_SQL} SELECT replay, seq, frame, goal_team, scorer, assist FROM credits",
)
def goal_touch_credits(spark, folder):
    chain = _chain(spark, folder)
    return T.goal_credits(chain.filter("is_touch"), goal_rows(chain)).drop("segment")


@query(
    "goal_kick_credits", "JON-17",
    f"""WITH {EVENTS_SQL},
    hist AS (
      SELECT g.replay, g.seq, g.frame AS gf, g.goal_team, k.player, k.team, k.frame, k.seq AS kseq,
             row_number() OVER (PARTITION BY g.replay, g.seq ORDER BY k.seq DESC) AS n
      FROM goals g JOIN kicks k ON k.replay = g.replay AND k.segment = g.segment
    ),
    recent AS (SELECT * FROM hist WHERE n <= 12 AND gf - frame <= 600),
    scorers AS (
      SELECT replay, seq, min(n) AS sn, arg_min(player, n) AS sp FROM recent
      WHERE team = goal_team AND gf - frame <= 300 GROUP BY ALL
    ),
    stops AS (
      SELECT r.replay, r.seq, min(r.n) AS xn FROM recent r JOIN scorers s USING (replay, seq)
      WHERE r.n > s.sn AND r.team <> r.goal_team GROUP BY ALL
    ),
    assists AS (
      SELECT r.replay, r.seq, arg_min(r.player, r.n) AS ap FROM recent r JOIN scorers s USING (replay, seq)
      LEFT JOIN stops x USING (replay, seq)
      WHERE r.n > s.sn AND r.team = r.goal_team AND r.player <> s.sp AND r.n < coalesce(x.xn, 1000) GROUP BY ALL
    )
    SELECT g.replay, g.seq, g.frame, g.goal_team, s.sp AS scorer, a.ap AS assist
    FROM goals g LEFT JOIN scorers s USING (replay, seq) LEFT JOIN assists a USING (replay, seq)""",
)
def goal_kick_credits(spark, folder):
    chain = _chain(spark, folder)
    return T.kick_goal_credits(chain.filter(F.col("kind") == "kick"), goal_rows(chain)).drop("segment")


@query(
    "player_touch_totals", "AGG-07 WIN-04",
    f"""WITH {EVENTS_SQL},
    parts AS (
      SELECT replay, player AS who, 1 AS t, outcome AS o, 1 AS own, under_pressure AS up, pressure_distance AS pd, progression AS pr
      FROM touches
      UNION ALL
      SELECT replay, next_player, 0, outcome, 0, false, NULL, NULL FROM touches WHERE outcome IN (2, 3)
    )
    SELECT replay, who AS player, CAST(sum(t) AS BIGINT) AS touches,
           count(*) FILTER (own = 1 AND o = 1) AS self_retouches,
           count(*) FILTER (own = 1 AND o = 2) AS team_touch_transfers_out,
           count(*) FILTER (own = 0 AND o = 2) AS team_touch_receipts,
           count(*) FILTER (own = 1 AND o = 3) AS turnovers,
           count(*) FILTER (own = 0 AND o = 3) AS recoveries,
           count(pd) AS pressure_observations,
           count(*) FILTER (up) AS under_pressure_touches,
           count(*) FILTER (up AND o IN (1, 2, 3)) AS pressured_transitions,
           count(*) FILTER (up AND o IN (1, 2)) AS retained_under_pressure,
           count(*) FILTER (up AND o = 3) AS lost_under_pressure,
           count(pr) FILTER (o IN (1, 2, 3)) AS touch_progression_events,
           round(coalesce(sum(pr) FILTER (o IN (1, 2, 3)), 0), 4) AS touch_progression_sum,
           round(avg(pd), 6) AS average_pressure_distance,
           round(count(*) FILTER (own = 1 AND o = 2) / nullif(count(*) FILTER (own = 1 AND o IN (2, 3)), 0), 6) AS touch_retention_rate,
           round(count(*) FILTER (up AND o IN (1, 2)) / nullif(count(*) FILTER (up AND o IN (1, 2, 3)), 0), 6) AS pressured_retention_rate
    FROM parts GROUP BY ALL""",
)
def player_touch_totals(spark, folder):
    totals = T.touch_totals(touch_rows(spark, folder))
    rounded = ["average_pressure_distance", "touch_retention_rate", "pressured_retention_rate"]
    return totals.select(
        "replay", "player", "touches", "self_retouches", "team_touch_transfers_out", "team_touch_receipts",
        "turnovers", "recoveries", "pressure_observations", "under_pressure_touches", "pressured_transitions",
        "retained_under_pressure", "lost_under_pressure", "touch_progression_events",
        F.round("touch_progression_sum", 4).alias("touch_progression_sum"),
        *[F.round(c, 6).alias(c) for c in rounded],
    )


@query(
    "player_kick_totals", "AGG-07 WIN-05",
    f"""WITH {EVENTS_SQL},
    parts AS (
      SELECT replay, player AS who, 'own' AS r, outcome AS o, under_pressure AS up, linked AND pt <> team AS won FROM kick_rows
      UNION ALL SELECT replay, next_player, 'next', outcome, false, false FROM kick_rows WHERE next_player IS NOT NULL
    )
    SELECT replay, who AS player, count(*) FILTER (r = 'own') AS kick_events,
           count(*) FILTER (r = 'own' AND up) AS under_pressure_kick_events,
           count(*) FILTER (r = 'own' AND o = 1) AS kick_self_retouches,
           count(*) FILTER (r = 'own' AND o = 2) AS kick_transfers_to_teammate,
           count(*) FILTER (r = 'own' AND o = 3) AS kick_transfers_to_opponent,
           count(*) FILTER (r = 'next' AND o = 2) AS received_kick_transfers,
           count(*) FILTER (r = 'next' AND o = 3) AS intercepted_kick_transfers,
           count(*) FILTER (r = 'own' AND won) AS inferred_recoveries
    FROM parts GROUP BY ALL""",
)
def player_kick_totals(spark, folder):
    return T.kick_totals(kick_rows(spark, folder)).select(
        "replay", "player", "kick_events", "under_pressure_kick_events", "kick_self_retouches",
        "kick_transfers_to_teammate", "kick_transfers_to_opponent", "received_kick_transfers",
        "intercepted_kick_transfers", "inferred_recoveries",
    )


@query(
    "goal_totals", "AGG-07 JON-16",
    f"""WITH {EVENTS_SQL}, {GOAL_CREDIT_SQL}
    SELECT replay, who AS player, CAST(sum(g) AS BIGINT) AS goals, CAST(sum(a) AS BIGINT) AS assists
    FROM (SELECT replay, scorer AS who, 1 AS g, 0 AS a FROM credits WHERE scorer IS NOT NULL
          UNION ALL SELECT replay, assist, 0, 1 FROM credits WHERE assist IS NOT NULL) GROUP BY ALL""",
)
def goal_totals(spark, folder):
    chain = _chain(spark, folder)
    return T.goal_totals(T.goal_credits(chain.filter("is_touch"), goal_rows(chain)))


@query(
    "artifact_feature_summary", "AGG-21",
    f"""WITH {EVENTS_SQL}
    SELECT replay, count(*) AS touches, count(*) FILTER (outcome = 2) AS team_touch_transfers_out,
           count(*) FILTER (outcome = 3) AS turnovers, count(*) FILTER (outcome = 3) AS recoveries,
           (SELECT count(*) FROM (SELECT player AS p FROM touches t WHERE t.replay = o.replay GROUP BY 1)) AS players
    FROM touches o GROUP BY ALL""",
)
def artifact_feature_summary(spark, folder):
    return T.artifact_summary(T.touch_totals(touch_rows(spark, folder)))


@query(
    "event_kind_counts", "AGG-21",
    f"WITH {EVENTS_SQL} SELECT replay, kind, count(*) AS n FROM ev GROUP BY ALL",
)
def event_kind_counts(spark, folder):
    return adapters.events(spark, folder).groupBy("replay", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "touch_heatmap", "AGG-05 PRJ-10",
    f"""WITH {EVENTS_SQL}
    SELECT player, concat(CAST(floor(ball_x / 20) AS BIGINT), ':', CAST(floor(ball_y / 20) AS BIGINT)) AS bin, count(*) AS n
    FROM touches0 GROUP BY ALL""",
)
def touch_heatmap(spark, folder):
    return T.position_histogram(_chain(spark, folder).filter("is_touch"), ["player"], "ball_x", "ball_y")


@query(
    "direction_histogram", "AGG-05 PRJ-14",
    f"""WITH {EVENTS_SQL}
    SELECT player, concat(dir_x, ':', dir_y) AS direction, min((dir_y + 1) * 3 + dir_x + 1) AS direction_class, count(*) AS n
    FROM ev WHERE kind IN ('input', 'kick') GROUP BY ALL""",
)
def direction_histogram(spark, folder):
    from touchline.functions.scalars import direction_class

    moves = adapters.events(spark, folder).filter(F.col("kind").isin("input", "kick"))
    return moves.groupBy(
        "player", F.concat_ws(":", F.col("dir_x").cast("string"), F.col("dir_y").cast("string")).alias("direction")
    ).agg(
        F.min(direction_class(F.col("dir_x").cast("double"), F.col("dir_y").cast("double"))).alias("direction_class"),
        F.count(F.lit(1)).alias("n"),
    )
