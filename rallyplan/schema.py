"""Contracts of the tracking tables, and fixed values of court and rules."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

# Court in metres, origin at the net's centre, y towards the far end.
LENGTH, DOUBLES_WIDTH, SINGLES_WIDTH = 23.77, 10.97, 8.23
SERVICE_LINE = 6.40
HALF_LENGTH, HALF_DOUBLES, HALF_SINGLES = LENGTH / 2, DOUBLES_WIDTH / 2, SINGLES_WIDTH / 2
NET_CENTRE, NET_POST, NET_POST_X = 0.914, 1.07, 6.40
# Strokes in the order in which reports list them.
STROKES = ("serve", "forehand", "backhand", "volley_forehand", "volley_backhand", "overhead")
# Keypoints of a pose, in order.
KEYPOINTS = (
    "nose", "l_eye", "r_eye", "l_ear", "r_ear", "l_shoulder", "r_shoulder", "l_elbow", "r_elbow",
    "l_wrist", "r_wrist", "l_hip", "r_hip", "l_knee", "r_knee", "l_ankle", "r_ankle",
)


@dataclass(frozen=True)
class Thresholds:
    """Tunable limits of the rules; the defaults are the reference results' ones."""

    rally_gap_s: float = 3.0
    missed_hit_gap_s: float = 5.0
    serve_pause_s: float = 5.0
    serve_min_depth_m: float = 10.5
    serve_max_x_m: float = 4.5
    fault_gap_s: float = 25.0
    fault_max_shots: int = 2
    centre_mark_m: float = 0.2
    pad_before_s: float = 0.5
    pad_after_s: float = 1.5

    @classmethod
    def of(cls, **settings: float) -> Thresholds:
        """Defaults with some settings changed; an unknown name or a value of another kind is an error."""
        known = {f.name: f.type for f in fields(cls)}
        if unknown := sorted(set(settings) - set(known)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        if bad := sorted(k for k, v in settings.items() if isinstance(v, bool) or not isinstance(v, (int, float))):
            raise ValueError(f"not numbers: {', '.join(bad)}")
        return cls(**settings)


LIMITS = Thresholds()


def _struct(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "byte": T.ByteType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "floats": T.ArrayType(T.FloatType()), "strings": T.ArrayType(T.StringType()), "bool": T.BooleanType(), "timestamp": T.TimestampType(), "stats": T.MapType(T.StringType(), T.DoubleType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


#: Columnar tables of one video.
FRAME_TIMES = _struct("frame_idx:long pts:double")
ONSETS = _struct("t:double strength:float peak_db:float prominence_db:float")
PEOPLE = _struct("frame_idx:long t:double track_id:int x1:float y1:float x2:float y2:float conf:float foot_px:float foot_py:float court_x:float court_y:float kp_x:floats kp_y:floats kp_c:floats appearance:floats")
BALL = _struct("frame_idx:long t:double x:float y:float track:int strength:float")
MOTION = _struct("frame_idx:long t:double track:int kp_x:floats kp_y:floats kp_c:floats height:float")
HITS = _struct("t:double side:byte track:int score:float loudness:float sound:float swing:float timing:float near:float turn:float ball_seen:float sources:strings")
#: Relational tables.
SESSION = _struct("id:long kind:string kind_source:string kind_confidence:double status:string duration_s:double created_at:timestamp recorded_at:timestamp")
VIDEO = _struct("id:long session_id:long offset_s:double sync_method:string fps:double warnings:strings")
PLAYER = _struct("id:long name:string handedness:string height_m:double merged_into:long")
SESSION_PLAYER = _struct("session_id:long player_id:long label:string match_distance:double stats:stats")
RALLY = _struct("id:long session_id:long index:long start_s:double end_s:double shot_count:long server_id:long winner_id:long end_reason:string score_before:string")
SHOT = _struct("id:long session_id:long rally_id:long player_id:long video_id:long t:double stroke:string spin:string speed_kmh:double avg_speed_kmh:double net_clearance_m:double apex_m:double contact_height_m:double hit_x:double hit_y:double bounce_x:double bounce_y:double in_court:bool depth:string direction:string outcome:string crosses_net:bool sources:strings")
SHOT_METRIC = _struct("shot_id:long name:string value:double")
JOB = _struct("id:long session_id:long status:string progress:double pid:long")
