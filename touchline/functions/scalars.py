"""Column expressions for names, times, identities and small derivations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frame rate, pitch bins and pressure rules of the recorded format.
FRAMES_PER_SECOND = 60
HEAT_BIN = 20
UNDER_PRESSURE_DISTANCE = 45
CLOSE_BALL_DISTANCE = 30
REPLAY_MAGIC = "HBR2"
REPLAY_VERSION = 3
HEADER_BYTES = 12

# The patterns of report texts and file names.
REPORT_ID_PATTERN = r"(?i)MATCH\s+REPORT(?:\s+SCRIM)?\s+#([A-Za-z0-9_.:-]+)"
SCORE_PATTERN = r"(?i)(?:\*\*)?Red\s+Team(?:\*\*)?\s*(\d+)\s*-\s*(\d+)\s*(?:\*\*)?Blue\s+Team(?:\*\*)?"
POSSESSION_PATTERN = r"(?is)Possession:\s*[^\d]*(\d+(?:\.\d+)?)%.*?(\d+(?:\.\d+)?)%"
HASHED_STEM_PATTERN = r"^(.+)-[0-9a-fA-F]{5,64}$"
REPLAY_TIME_PATTERN = r"(?i)^(\d{2})-(\d{2})-(\d{2,4})-(\d{2})h(\d{2})"


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` limited to [low, high]; null stays null."""
    limited = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), limited)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def matched(text: Column, pattern: str, group: int) -> Column:
    """Regex group, null where the pattern is absent."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


# ---- names and identities -------------------------------------------------------------------------


def fold_case(text: Column) -> Column:
    """Full case folding: ``ß`` becomes ``ss``, ligatures come apart, final sigma is sigma.

    Upper then lower does that; the empty suffix keeps the optimizer from reducing the pair to ``lower``.
    """
    return F.translate(F.lower(F.concat(F.upper(text), F.lit(""))), "ς", "σ")


def display_name(name: Column) -> Column:
    """Trimmed name with runs of white space made one space."""
    return F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def name_key(name: Column) -> Column:
    """Case-folded display name; empty names are null."""
    return _shown_key(display_name(name))


def _shown_key(shown: Column) -> Column:
    return F.when(F.length(shown) > 0, fold_case(shown))


def identity_key(auth: Column, name: Column, *, strict_auth: bool = False, shown: bool = False) -> Column:
    """``auth:<hash>``, else ``name:<key>``, else null.

    With ``strict_auth`` the hash is trimmed and a blank one makes the identity null instead of
    falling back to the name. ``shown``: the name is a display name already.
    """
    by_name = F.concat(F.lit("name:"), _shown_key(name) if shown else name_key(name))
    if strict_auth:
        trimmed = F.regexp_replace(auth, r"(?U)^\s+|\s+$", "")
        by_auth = F.when(F.length(trimmed) > 0, F.concat(F.lit("auth:"), trimmed))
        return F.when(auth.isNotNull(), by_auth).otherwise(by_name)
    return F.when(F.length(auth) > 0, F.concat(F.lit("auth:"), auth)).otherwise(by_name)


def pseudonym(auth: Column) -> Column:
    """First 20 hex digits of the SHA-256 of an account id; empty ids stay null."""
    return F.when(F.length(auth) > 0, F.substring(F.sha2(auth, 256), 1, 20))


# ---- geometry ------------------------------------------------------------------------------------


def attack_x(team: Column, x: Column) -> Column:
    """x along the attack direction of a team, 0 for spectators."""
    return F.when(team == 1, x).when(team == 2, -x).otherwise(F.lit(0.0))


def heat_bin(x: Column, y: Column, size: int = HEAT_BIN) -> Column:
    """Key ``"bx:by"`` of the pitch square that holds a position."""
    return F.concat_ws(":", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def direction_class(dir_x: Column, dir_y: Column) -> Column:
    """Class 0-8 of a movement direction; halves round to even."""
    dx = clamp(F.rint(dir_x), -1, 1)
    dy = clamp(F.rint(dir_y), -1, 1)
    return ((dy + 1) * 3 + (dx + 1)).cast("int")


def direction_from_class(class_id: Column) -> tuple[Column, Column]:
    """(dir_x, dir_y) of a direction class."""
    return (class_id % 3 - 1).cast("int"), (F.floor(class_id / 3) - 1).cast("int")


# ---- file names and times -------------------------------------------------------------------------


def file_stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot is part of the stem."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def file_suffix(name: Column) -> Column:
    """Last suffix with its dot, empty if there is none."""
    return F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)


def base_stem(stem: Column) -> Column:
    """Stem without a trailing ``-<5 to 64 hex digits>``."""
    return F.when(stem.rlike(HASHED_STEM_PATTERN), F.regexp_extract(stem, HASHED_STEM_PATTERN, 1)).otherwise(stem)


def replay_time(file_name: Column) -> Column:
    """Local time in a name like ``24-09-26-22h12-...``; null when absent or impossible."""
    part = [F.regexp_extract(file_name, REPLAY_TIME_PATTERN, i).cast("int") for i in range(1, 6)]
    day, month, year, hour, minute = part
    year = F.when(year < 100, year + 2000).otherwise(year)
    return F.when(
        file_name.rlike(REPLAY_TIME_PATTERN), F.try_make_timestamp_ntz(year, month, day, hour, minute, F.lit(0))
    )


def report_time(value: Column) -> Column:
    """Wall-clock part of an ISO time; an offset is dropped on purpose."""
    local = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)", 1)
    date_only = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})$", 1)
    text = F.when(F.length(local) > 0, local).when(F.length(date_only) > 0, date_only)
    return text.try_cast("timestamp_ntz")


def local_seconds(time: Column) -> Column:
    """Seconds of a local time since 1970, whatever time zone the session has."""
    since = time - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return since.cast("interval second").cast("decimal(20,6)").cast("double")


def seconds_between(a: Column, b: Column) -> Column:
    """Absolute difference of two local times in seconds."""
    return F.abs(local_seconds(a) - local_seconds(b))


def holdout_bucket(sha: Column, modulus: int, salt: str = "holdout-v1:") -> Column:
    """Stable bucket of a replay: the first 8 bytes of a salted SHA-256, big endian, modulo ``modulus``.

    ``salt`` is a parameter so that splits frozen earlier under another salt can be reproduced.
    """
    digest = F.substring(F.sha2(F.concat(F.lit(salt), sha), 256), 1, 16)
    return (F.conv(digest, 16, 10).cast("decimal(20,0)") % F.lit(modulus).cast("decimal(20,0)")).cast("int")


def canonical_match_id(report_id: Column, sha: Column) -> Column:
    """Report id, else a key made of the content hash."""
    return F.coalesce(
        F.when(F.length(report_id) > 0, report_id), F.concat(F.lit("hbr2:"), F.substring(sha, 1, 16))
    )


# ---- report texts --------------------------------------------------------------------------------


def looks_like_match_report(content: Column, names: Column) -> Column:
    """An attachment named like a replay, or the words of a report in the text."""
    text = F.upper(F.coalesce(content, F.lit("")))
    has_replay = F.coalesce(
        F.exists(names, lambda n: F.coalesce(F.lower(n).endswith(".hbr2"), F.lit(False))), F.lit(False)
    )
    return has_replay | text.contains("MATCH REPORT") | (text.contains("RED TEAM") & text.contains("BLUE TEAM"))


def report_fields(content: Column) -> dict[str, Column]:
    """Report id, scores and possession found in a text; null where absent."""
    text = F.coalesce(content, F.lit(""))
    return {
        "report_id": matched(text, REPORT_ID_PATTERN, 1),
        "red_score": matched(text, SCORE_PATTERN, 1).try_cast("int"),
        "blue_score": matched(text, SCORE_PATTERN, 2).try_cast("int"),
        "possession_red": matched(text, POSSESSION_PATTERN, 1).try_cast("double"),
        "possession_blue": matched(text, POSSESSION_PATTERN, 2).try_cast("double"),
    }


# ---- replay header -------------------------------------------------------------------------------


def header_probe(content: Column, length: Column) -> dict[str, Column]:
    """Magic, version, frame count, duration and the reasons why a header is not accepted."""
    whole = length >= HEADER_BYTES
    magic = F.when(whole, F.substring(content, 1, 4))
    number = lambda start: F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("long")
    version, frames = F.when(whole, number(5)), F.when(whole, number(9))
    reason = (
        F.when(~whole, F.lit("truncated_header"))
        .when(magic != F.lit(REPLAY_MAGIC).cast("binary"), F.lit("invalid_magic"))
        .when(version != REPLAY_VERSION, F.concat(F.lit("unsupported_version:"), version.cast("string")))
        .when(frames <= 0, F.lit("invalid_total_frames"))
    )
    return {
        "version": version,
        "total_frames": frames,
        "duration_seconds": frames / FRAMES_PER_SECOND,
        "error": reason,
    }


def tuned_variant(generation: Column) -> dict[str, Column]:
    """Hyper-parameters and seed of a generation: a fixed grid of eight, repeated."""
    # Fixed values: (hidden units, epochs, learning rate, l2, batch size).
    grid = [
        (64, 4, 0.0010, 0.00001, 8192),
        (96, 4, 0.0008, 0.00001, 8192),
        (128, 4, 0.0006, 0.00002, 8192),
        (64, 6, 0.0005, 0.00001, 8192),
        (96, 5, 0.0004, 0.00005, 4096),
        (128, 3, 0.0010, 0.00005, 4096),
        (64, 8, 0.0003, 0.00002, 4096),
        (96, 6, 0.0007, 0.00002, 8192),
    ]
    index = F.pmod(generation - 1, F.lit(len(grid))).cast("int")
    pick = lambda position: F.element_at(F.array(*[F.lit(row[position]) for row in grid]), index + 1)
    return {
        "hidden_dim": pick(0),
        "epochs": pick(1),
        "learning_rate": pick(2),
        "l2": pick(3),
        "batch_size": pick(4),
        "seed": generation * 7919 + 1337,
        "variant_index": index,
    }


def composite_score(joint: Column, kick_f1: Column) -> Column:
    """0.7 of joint accuracy plus 0.3 of kick F1."""
    return F.lit(0.70) * joint + F.lit(0.30) * kick_f1


def example_weight(conservative_score: Column) -> Column:
    """Training weight of a replay from the best conservative score in it."""
    return F.bround(clamp(F.lit(1.0) + (conservative_score - 50.0) / 10.0, 0.25, 2.0), 4)
