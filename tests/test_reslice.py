from math import floor

from sonoloom.plans import frame_queries
from sonoloom.sources.views import frames


def test_every_pixel_of_every_frame_against_brute_force(spark, sf):
    clips = {}
    for r in frames(spark, sf).collect():
        clips.setdefault(r.clip_id, {})[r.frame_no] = r.pixels

    def sample(clip, x, y, z):
        total = 0.0
        for i in (0, 1):
            for j in (0, 1):
                for k in (0, 1):
                    a, b, c = floor(x) + i, floor(y) + j, floor(z) + k
                    w = (1 - abs(x - a)) * (1 - abs(y - b)) * (1 - abs(z - c))
                    if 0 <= a < 8 and 0 <= b < 8 and c in clip:
                        total += w * clip[c][b * 8 + a]
        return total

    rows = frame_queries.R.queries["reslice_secondary_all"](spark, sf).collect()
    found = {(r.clip_id, r.frame_no, r.pos): r.v for r in rows}
    assert len(clips) > 1 and len(found) == len(rows) == sum(64 * len(c) for c in clips.values())
    for (clip, n, pos), v in found.items():
        assert abs(v - sample(clips[clip], pos % 8 * 0.5, pos // 8 * 0.5, n * 0.25)) < 1e-5
