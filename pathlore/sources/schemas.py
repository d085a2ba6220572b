"""Declared schemas of the input files (column names are fixed values of the data format)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_L, _I, _D, _S, _N = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()

LEVEL_FILE = _struct(
    game_id=_L, user_id=_L, session_number=_I, game_in_session=_I, total_games_played=_I, source=_S,
    date_played=_N, game_duration=_D, win=_I, level=_I,
)
LEVEL_RENAMES = {
    "game_id": "level_id",
    "game_duration": "duration",
    "game_in_session": "level_in_session",
    "total_games_played": "total_levels_played",
}

STATE_FILE = _struct(
    game_state_id=_L, game_id=_L, user_id=_L, time_elapsed=_D, score=_I, lives=_I, pellets=_I, powerPellets=_I,
    pacman_attack=_I, Pacman_X=_D, Pacman_Y=_D,
    **{f"Ghost{g}_{a}": _D for g in (1, 2, 3, 4) for a in "XY"},
    **{f"ghost{g}_state": _I for g in (1, 2, 3, 4)},
    **{f"powerpelletstate_{j}": _I for j in (1, 2, 3, 4)},
    fruitState_1=_I, fruitState_2=_I, input_direction=_S, movement_direction=_S,
)
STATE_RENAMES = {"game_id": "level_id"}

_ITEMS = {
    **{f"fss_{i}": _D for i in range(1, 9)},
    **{f"bis_{i}": _D for i in range(1, 8)},
    **{f"rew_{i}": _D for i in range(1, 6)},
    **{f"drive_{i}": _D for i in range(1, 5)},
    **{f"fun_{i}": _D for i in range(1, 5)},
}
SIDE_TABLES = {
    "user": _struct(user_id=_L, username=_S),
    "userip": _struct(user_id=_L, ip=_S),
    "psychometrics": _struct(
        record_id=_L, redcap_repeat_instrument=_S, redcap_repeat_instance=_I, total_games_flow=_I,
        consent_timestamp=_S, age=_I, gender=_S, nationality=_S, edu=_S, **_ITEMS,
    ),
}
TRAJECTORY_METADATA = [
    "level_id", "game_id", "user_id", "session_number", "level_in_session", "total_levels_played", "duration",
    "win", "level",
]
