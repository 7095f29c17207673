"""Schemas of the tables that go in and out."""

VIDEO_META = "match_id bigint, fps double, total_frames bigint, width int, height int"
DETECTIONS = "match_id bigint, frame bigint, ord bigint, x1 float, y1 float, x2 float, y2 float, conf float, cls int"
TRACKS_PLAYER = "match_id bigint, frame bigint, ord bigint, tid bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"
TRACKS_BALL = "match_id bigint, frame bigint, ord bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, conf float"
ASSOCIATED = "match_id bigint, frame bigint, ord bigint, tid bigint, x1 double, y1 double, x2 double, y2 double, conf double, det_ord bigint"
RESOLVED = TRACKS_PLAYER + ", cx bigint, cy bigint, occluded boolean, id int, outcome string, status string, reid_d2 bigint, free int, static int"
OBSERVATIONS = ["match_id", "frame", "id", "x", "y", "x1", "y1", "x2", "y2", "en_oclusion"]
BALL_OBSERVATIONS = ["match_id", "frame", "x", "y"]
