"""Plain-Python statements of the rules, for small fixtures only (brute force)."""

import math


def windows(rows, lookback, step, profile, cfg):
    """(end index, reason or candidate dict) for every full window of sorted (ts, o, h, l, c, v) rows."""
    out = []
    trs = []
    for i, (_, o, h, l, c, v) in enumerate(rows):
        if not (math.isfinite(h) and math.isfinite(l) and h > 0 and l > 0 and h >= l):
            trs.append(None)
            continue
        pc = rows[i - 1][4] if i else None
        trs.append(h - l if pc is None or not math.isfinite(pc) or pc <= 0 else max(h - l, abs(h - pc), abs(l - pc)))
    for e in range(lookback - 1, len(rows)):
        w = rows[e - lookback + 1: e + 1]
        steps = [b[0] - a[0] for a, b in zip(w, w[1:])]
        bad = sum(1 for _, o, h, l, c, _v in w if h < l or min(o, h, l, c) <= 0)
        zero = sum(1 for r in w if not r[5] > 0)
        hi, lo, close = max(r[2] for r in w), min(r[3] for r in w), w[-1][4]
        height = hi - lo
        pct = height / close if close else 0.0
        pos = (close - lo) / height if height else 0.0
        mid, low_edge, high_edge = lo + 0.5 * height, lo + cfg["lower_zone_pct"] * height, hi - cfg["upper_zone_pct"] * height
        lower, upper = [r[3] <= low_edge for r in w], [r[2] >= high_edge for r in w]
        crosses = sum(1 for a, b in zip(w, w[1:]) if (a[4] < mid < b[4]) or (a[4] > mid > b[4]))
        tail = trs[e - 13: e + 1] if e >= 13 else [None]
        atr = None if None in tail else math.fsum(tail) / 14
        ratio = height / atr if atr else None
        slope = abs((close - w[0][4]) / w[0][4]) if w[0][4] else 0.0
        half = cfg["mid_zone_pct"] / 2
        checks = [
            ("missing_window", w[-1][0] - w[0][0] != (lookback - 1) * step), ("duplicate_timestamp", 0 in steps),
            ("missing_window", any(s != step for s in steps)), ("bad_ohlc_window", bad > 0),
            ("zero_volume_window", zero > int(lookback * min(cfg["max_zero_volume_window_pct"], profile["max_zero_volume_window_pct"]))),
            ("range_height", height <= 0 or pct < max(cfg["min_range_height_pct"], profile["range_height_pct_min"]) or pct > profile["range_height_pct_max"]),
            ("middle_zone", not 0.5 - half <= pos <= 0.5 + half), ("lower_upper_entry", not (any(lower) and any(upper))),
            ("midline_cross", crosses < profile["min_midline_cross_count"]),
            ("touch_count", sum(lower) < profile["min_touches_lower_zone"] or sum(upper) < profile["min_touches_upper_zone"]),
            ("slope", slope > profile["max_abs_slope_pct_per_window"]),
            ("range_atr", ratio is not None and (not profile["range_height_atr_min"] <= ratio <= profile["range_height_atr_max"] or ratio < profile["min_path_length_over_range"])),
        ]
        reason = next((n for n, hit in checks if hit), None)
        if reason:
            out.append((e, reason, None))
            continue
        rets = [math.log(b[4]) - math.log(a[4]) for a, b in zip(w, w[1:])]
        mean = math.fsum(rets) / len(rets) if rets else 0.0
        out.append((e, None, {
            "range_low": lo, "range_high": hi, "touches_lower_zone": sum(lower), "touches_upper_zone": sum(upper), "midline_crosses": crosses,
            "atr_14": atr, "realized_volatility": math.sqrt(math.fsum((r - mean) ** 2 for r in rets) / len(rets)) if rets else 0.0,
            "mean_abs_return_inside_range": math.fsum(abs(r) for r in rets) / len(rets) if rets else 0.0,
            "time_since_last_lower_touch_minutes": lookback - 1 - max(i for i, x in enumerate(lower) if x), "volume_sum_window": math.fsum(r[5] for r in w),
        }))
    return out


def greedy_events(times, cooldown, step):
    """Accepted first-of-run times under the greedy cooldown."""
    kept, last = [], None
    for i, t in enumerate(times):
        if (i and t - times[i - 1] == step) or (last is not None and t - last < cooldown * step):
            continue
        kept.append(t)
        last = t
    return kept


def count_levels(closes, lows, highs, levels):
    """(close crossings, intrabar touches, distinct levels touched)."""
    crosses = sum(1 for a, b in zip(closes, closes[1:]) for lv in levels if a != b and min(a, b) < lv <= max(a, b))
    touches = sum(1 for lo, hi in zip(lows, highs) for lv in levels if lo <= lv <= hi)
    seen = sum(1 for lv in levels if any(lo <= lv <= hi for lo, hi in zip(lows, highs)))
    return crosses, touches, seen
