"""Named queries over the driver's tables, each over its whole tables, with the SQL that states the same result.

Figures are rounded in the last projection alone, as the two engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.operators import chunking, evaluation, fusion, metrics, resample, segments, signal, spectral, textgrid, timebase, tracks, transcript
from voxframe.operators import decode as dec
from voxframe.sources import audio
from voxframe.sources import driver_tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HIGH_RECALL = dec.Tuning(high_recall=True)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*(r(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


# ---- grids -----------------------------------------------------------------------------------------------------------


@query(f"""with {T.FRAMES} select rec, frame, round(frame * 0.01::double, 6) as time_s, floor(round(frame * 0.01::double, 6) / 0.01::double)::bigint as back, ceil(round(frame * 0.01::double, 6) / 0.01::double)::bigint as n_frames from frames""")
def frame_time_map(spark, d):
    t = T.frames(spark, d).select("rec", "frame", F.round(timebase.frame_time(F.col("frame")), 6).alias("time_s"))
    return t.withColumn("back", timebase.time_frame(F.col("time_s"))).withColumn("n_frames", timebase.frame_count(F.col("time_s")))


@query(f"with {T.EVENT_TRACK} select rec, frame * 2 + j as frame, round(value, 6) as value from track, (values (0), (1)) s(j)")
def upsample_hold(spark, d):
    return rounded(resample.upsample_hold(T.event_track(spark, d), 2), "value").select("rec", "frame", "value")


def _blocks(how: str) -> str:
    return f"""with {T.FRAMES}, sized as (select *, count(*) over (partition by rec) as n from frames)
    select rec, frame // 4 as frame, round({how}(vad), 6) as vad, round({how}(diar_a), 6) as diar_a from sized where frame < n - n % 4 group by 1, 2"""


def _whole(spark, d, times: int) -> DataFrame:
    f = T.frames(spark, d).withColumn("n", F.count("*").over(W.partitionBy("rec")))
    return f.where(F.col("frame") < F.col("n") - F.col("n") % times)


@query(_blocks("avg"))
def downsample_mean(spark, d):
    return rounded(resample.downsample(_whole(spark, d, 4), 4, {"vad": "mean", "diar_a": "mean"}), "vad", "diar_a")


@query(_blocks("max"))
def downsample_max(spark, d):
    return rounded(resample.downsample(_whole(spark, d, 4), 4, {"vad": "max", "diar_a": "max"}), "vad", "diar_a")


def _long(frames: DataFrame, names=("vad", "diar_a", "diar_b", "leak")) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("track"), F.col(n).alias("value")) for n in names])
    return frames.select("rec", "frame", F.explode(pairs).alias("t")).select("rec", "t.track", "frame", F.lit(0).alias("k"), "t.value", F.lit(1.0).alias("confidence"))


LONG = "long as (select rec, track, frame, 0 as k, value, 1::double as confidence from frames unpivot (value for track in (vad, diar_a, diar_b, leak)))"


@query(f"""with {T.FRAMES}, {LONG} select rec, track, frame // 4 as frame, k, round(case when track = 'vad' then max(value) else avg(value) end, 6) as value,
 round(case when track = 'vad' then max(confidence) else avg(confidence) end, 6) as confidence from long group by rec, track, frame // 4, k""")
def resample_all_tracks(spark, d):
    out = resample.resample_all(_long(T.frames(spark, d)), 4, F.when(F.col("track") == "vad", "max").otherwise("mean"))
    return rounded(out, "value", "confidence")


# ---- signal ----------------------------------------------------------------------------------------------------------

_RMS = "sqrt(list_sum(list_transform({0}, lambda x: x * x)) / len({0}))"
ENERGY = f"""{T.STEREO}, energy as (select *, {_RMS.format('"left"')} as el, {_RMS.format('"right"')} as er from stereo)"""


def _energy(spark, d) -> DataFrame:
    return signal.energies(T.stereo_frames(spark, d)).select("rec", "frame", "energy_left", "energy_right")


@query(f"with {ENERGY} select rec, frame, round(el, 6) as energy_left, round(er, 6) as energy_right from energy")
def rms_energy(spark, d):
    return rounded(_energy(spark, d), "energy_left", "energy_right")


SMOOTH = f"{ENERGY}, smoothed as (select rec, frame, sum(el) over (partition by rec order by frame rows between 4 preceding and 3 following) / 8 as smooth from energy)"


def _smooth(spark, d) -> DataFrame:
    return _energy(spark, d).select("rec", "frame", signal.smooth(F.col("energy_left"), signal.window_frames(80, 0.01)).alias("smooth"))


@query(f"with {SMOOTH} select rec, frame, round(smooth, 6) as smooth from smoothed")
def energy_smooth(spark, d):
    return rounded(_smooth(spark, d), "smooth")


@query(f"""with {SMOOTH}, raw as (select *, coalesce((smooth - lag(smooth) over w) / 0.01::double, 0) as s, count(*) over (partition by rec) as n, row_number() over w as i from smoothed window w as (partition by rec order by frame))
select rec, frame, round(case when n > 2 and i > n - 2 then 0 else sum(s) over (partition by rec order by frame rows between 1 preceding and current row) / 2 end, 4) + 0 as slope from raw""")
def energy_slope(spark, d):
    out = _smooth(spark, d)
    for name, c in signal.slope(F.col("smooth"), 0.01):
        out = out.withColumn(name, c)
    return rounded(out.select("rec", "frame", "slope"), "slope", digits=4)


@query(f"with {ENERGY} select rec, frame, round(ln((el + 1e-8::double) / (er + 1e-8::double)), 6) + 0 as log_ratio from energy")
def stereo_ratio(spark, d):
    e = _energy(spark, d)
    return rounded(e.select("rec", "frame", signal.log_ratio(F.col("energy_left"), F.col("energy_right")).alias("log_ratio")), "log_ratio")


@query(f"""with {T.STEREO}, samples as (select rec, frame, unnest("left") as l, unnest("right") as r from stereo)
select rec, frame, round(greatest(-1, least(1, corr(l, r))), 6) + 0 as correlation from samples group by rec, frame""")
def stereo_corr(spark, d):
    return rounded(T.stereo_frames(spark, d).select("rec", "frame", signal.correlation(F.col("left"), F.col("right")).alias("correlation")), "correlation")


@query(f"""with {T.STEREO}, samples as (select rec, unnest("left") as l, unnest("right") as r from stereo)
select rec, round(corr(l, r), 6) + 0 as correlation, case when corr(l, r) > 0.98::double then 'same' else 'different' end as label from samples group by rec""")
def channel_similarity(spark, d):
    pairs = T.stereo_frames(spark, d).select("rec", F.explode(F.arrays_zip("left", "right")).alias("s")).select("rec", F.col("s.left").alias("l"), F.col("s.right").alias("r"))
    return rounded(signal.channel_similarity(pairs), "correlation")


DIAR = f"""{ENERGY}, spoken as (select rec, frame, (el - er) / (el + er + 1e-8::double) as dom from energy),
diar as (select rec, frame, greatest(0.01::double, least(0.99::double, 0.5::double + 0.49::double * dom)) as diar_a, greatest(0.01::double, least(0.99::double, 0.5::double - 0.49::double * dom)) as diar_b from spoken)"""


@query(f"with {DIAR} select rec, frame, round(diar_a, 6) as diar_a, round(diar_b, 6) as diar_b from diar")
def stereo_diarization(spark, d):
    return rounded(signal.diarization(_energy(spark, d)).select("rec", "frame", "diar_a", "diar_b"), "diar_a", "diar_b")


@query(f"with {DIAR} select rec, frame, round(diar_a * diar_b, 6) as overlap from diar")
def overlap_proxy(spark, d):
    return rounded(signal.diarization(_energy(spark, d)).select("rec", "frame", signal.overlap_proxy(F.col("diar_a"), F.col("diar_b")).alias("overlap")), "overlap")


@query(f"""with {SMOOTH}, stats as (select rec, quantile_cont(smooth, 0.1) as q1, quantile_cont(smooth, 0.9) as q9, min(smooth) as lo, max(smooth) as hi, count(*) as n from smoothed group by rec),
bound as (select rec, n, case when q9 - q1 < 1e-6 then lo else q1 end as a, case when q9 - q1 < 1e-6 then hi else q9 end as b from stats),
scaled as (select s.rec, frame, n, case when b - a < 1e-6 then case when b > 1e-8 then 1::double else 0::double end else greatest(0::double, least(1::double, (smooth - a) / (b - a))) end as p, row_number() over (partition by s.rec order by frame) - 1 as i from smoothed s join bound using (rec))
select rec, frame, round(case when n > 1 then (sum(p) over (partition by rec order by frame rows between 4 preceding and 4 following) + greatest(0, 4 - i) * first_value(p) over (partition by rec order by frame) + greatest(0, i + 4 - (n - 1)) * last_value(p) over (partition by rec order by frame rows between unbounded preceding and unbounded following)) / 9::double else p end, 6) as vad from scaled""")
def energy_vad(spark, d):
    return rounded(signal.energy_vad(_smooth(spark, d), "smooth").select("rec", "frame", "vad"), "vad")


@query(f"""with {ENERGY}, ref as (select rec, quantile_cont(el + er, 0.9) as q from energy group by rec)
select e.rec, frame, round(abs((el - er) / (el + er + 1e-8::double)), 6) as dominance, round(greatest(0::double, least(1::double, (el + er) / (q + 1e-8::double))), 6) as gate from energy e join ref using (rec)""")
def leakage_gate(spark, d):
    return rounded(spectral.gate(_energy(spark, d)).select("rec", "frame", "dominance", "gate"), "dominance", "gate")


def _spectrum(side: str) -> str:
    """log1p of the power of each bin of a frame of 64 samples under a Hann window, by the sum that defines it."""
    return f"""(select rec, frame, k, ln(1 + pow(sum(x * cos(2 * pi() * k * i / 64)), 2) + pow(sum(x * sin(2 * pi() * k * i / 64)), 2)) as p
 from (select rec, frame, i, "{side}"[i + 1] * (0.5::double - 0.5::double * cos(2 * pi() * i / 63)) as x from stereo, range(0, 64) t(i)), range(0, 33) u(k) group by rec, frame, k)"""


@query(f"""with {ENERGY}, ref as (select rec, quantile_cont(el + er, 0.9) as q from energy group by rec),
alike as (select l.rec, l.frame, greatest(0::double, least(1::double, sum(l.p * r.p) / (sqrt(sum(l.p * l.p)) * sqrt(sum(r.p * r.p)) + 1e-8::double))) as likeness from {_spectrum('left')} l join {_spectrum('right')} r on l.rec = r.rec and l.frame = r.frame and l.k = r.k group by l.rec, l.frame)
select e.rec, e.frame, round(greatest(0::double, least(1::double, least(1::double, abs((el - er) / (el + er + 1e-8::double))) * likeness * least(1::double, (el + er) / (q + 1e-8::double)))), 6) as leakage from energy e join ref using (rec) join alike a on a.rec = e.rec and a.frame = e.frame""")
def leakage_likelihood(spark, d):
    return rounded(spectral.leakage(T.stereo_frames(spark, d)).select("rec", "frame", "leakage"), "leakage")


@query(f"""with {T.STEREO}, j as (select *, unnest(range(0, 100)) as i from stereo)
select rec, frame, i::int as i, round("left"[floor(i * 63::double / 99)::int + 1] + (coalesce("left"[floor(i * 63::double / 99)::int + 2], "left"[floor(i * 63::double / 99)::int + 1]) - "left"[floor(i * 63::double / 99)::int + 1]) * (i * 63::double / 99 - floor(i * 63::double / 99)), 6) + 0 as value from j""")
def waveform_interpolate(spark, d):
    out = T.stereo_frames(spark, d).select("rec", "frame", F.posexplode(resample.interpolate(F.col("left"), 100)).alias("i", "value"))
    return rounded(out, "value")


@query(f"""with {ENERGY}, samples as (select rec, frame, unnest("left") as l, unnest("right") as r from stereo), c as (select rec, frame, corr(l, r) as c from samples group by rec, frame)
select e.rec, e.frame, round(el, 6) as energy_left, round(er, 6) as energy_right, round(ln((el + 1e-8::double) / (er + 1e-8::double)), 6) + 0 as log_ratio, round(greatest(-1, least(1, c)), 6) + 0 as correlation from energy e join c on e.rec = c.rec and e.frame = c.frame""")
def stereo_evidence(spark, d):
    return rounded(signal.stereo_evidence(T.stereo_frames(spark, d)).select("rec", "frame", "energy_left", "energy_right", "log_ratio", "correlation"), "energy_left", "energy_right", "log_ratio", "correlation")


@query(f"""with {T.STEREO}, near as (select rec, frame, list_concat(list_concat(coalesce(lag("left") over w, list_transform("left", lambda x: 0::double)), "left"), coalesce(lead("left") over w, list_transform("left", lambda x: 0::double))) as x from stereo window w as (partition by rec order by frame)),
cut as (select rec, frame, x[47:146] as x from near) select rec, frame, len(x)::int as size, round({_RMS.format('x')}, 6) as rms from cut""")
def centred_window(spark, d):
    """Windows of 100 samples around the middle of frames of 64."""
    beside = lambda f: f("left").over(signal.by_rec())
    seen = T.stereo_frames(spark, d).withColumn("w", spectral.centred_window(F.col("left"), beside(F.lag), beside(F.lead), 100))
    return rounded(seen.select("rec", "frame", F.size("w").alias("size"), signal.rms(F.col("w")).alias("rms")), "rms")


SAMPLES = "samples as (select vec_id // 100 as rec, vec_id % 2 as channel, (vec_id % 100) // 2 * 64 + i as sample, embedding[i + 1]::double as value from embeddings, range(0, 64) t(i))"


@query(f"with {SAMPLES} select rec, channel, sample // 50 as frame, round(sum(value), 6) + 0 as total, round(arg_min(value, sample), 6) as first, round(arg_max(value, sample), 6) as last from samples group by all having count(*) = 50")
def framing(spark, d):
    """Samples of each channel in frames of 50; the rest at a recording's end goes."""
    vec = T.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("rec"), (F.col("vec_id") % 2).alias("channel"), F.floor((F.col("vec_id") % 100) / 2).alias("place"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "value"))
    cut = signal.frames_of(vec.select("rec", "channel", (F.col("place") * 64 + F.col("i")).alias("sample"), "value"), 1000, 0.05)
    return rounded(cut.select("rec", "channel", "frame", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("samples", 1).alias("first"), F.element_at("samples", -1).alias("last")), "total", "first", "last")


@query(f"""with {T.STEREO}, spot as (select rec, frame, "left" as x, round_even((frame % 7) * 0.1::double * 64, 0)::int as a, round_even(((frame % 7) * 0.1::double + 0.3::double) * 64, 0)::int as b from stereo), c as (select rec, frame, x[a + 1:least(b, 64)] as x from spot)
select rec, frame, len(x)::int as size, round(list_sum(x), 6) + 0 as total from c""")
def waveform_cut(spark, d):
    """Three tenths of a second of frames of 64 samples a second, from a start that some frames nearly end at."""
    start = (F.col("frame") % 7) * F.lit(0.1)
    seen = T.stereo_frames(spark, d).select("rec", "frame", resample.cut(F.col("left"), F.lit(64), start, start + F.lit(0.3)).alias("x"))
    return rounded(seen.select("rec", "frame", F.size("x").alias("size"), F.aggregate("x", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("select frame, round(frame * 0.01::double, 6) as time_s from range(0, 500) t(frame)")
def frame_times(spark, d):
    return rounded(timebase.TimeBase(0.01).frame_times(spark, 500), "time_s")


@query(f"with {T.EVENT_TRACK} select rec, frame * 2 + j as frame, round(value, 6) as value from track, (values (0), (1)) s(j)")
def canonical_up(spark, d):
    return rounded(resample.to_canonical(T.event_track(spark, d), timebase.TimeBase(0.02), {"value": None}).select("rec", "frame", "value"), "value")


@query(_blocks("avg"))
def canonical_down(spark, d):
    return rounded(resample.to_canonical(_whole(spark, d, 4), timebase.TimeBase(0.0025), {"vad": "mean", "diar_a": "mean"}), "vad", "diar_a")


@query(f"""with b as (select unnest(range(0, {len(audio.STRESS)})) as k, unnest({[x[0] for x in audio.STRESS]}) as state, unnest({[x[1] for x in audio.STRESS]}::double[]) as f, unnest({[x[2] for x in audio.STRESS]}::double[]) as l, unnest({[x[3] for x in audio.STRESS]}::double[]) as r)
select k * 8000 + i as sample, round(l * sin(2 * pi() * f * i / 16000::double), 6) + 0 as "left", round(r * sin(2 * pi() * f * i / 16000::double), 6) + 0 as "right", state from b, range(0, 8000) t(i)""")
def stress_recording(spark, d):
    return rounded(audio.stress_samples(spark), "left", "right")


@query("select 'r' as rec, frame, case when frame < 5 then 0.05::double when frame < 12 then 0.95::double when frame < 15 then 0.05::double else 0.95::double end as value from range(0, 20) t(frame)")
def synthetic_track(spark, d):
    return audio.vad_track(spark, "r", [("SIL", 5), ("A", 7), ("LEAK", 3), ("OVL", 5)])


@query(f"""with {T.TURNS}, seen as (select rec, start_time - 0.3::double as a, start_time + 4 as b, 0.2::double as s, end_time - start_time + 0.4::double as e, text from turns)
select rec, round(least(greatest(a + s, a), b), 6) as start_time, round(least(greatest(a + e, a), b), 6) as end_time, trim(text, ' ') as text from seen where least(greatest(a + e, a), b) - least(greatest(a + s, a), b) >= 1e-4::double""")
def recognised_segments(spark, d):
    """Turns as a recogniser would give them in windows of 4.3 seconds: in recording time, within the window."""
    raw = T.turns(spark, d).select("rec", (F.col("start_time") - F.lit(0.3)).alias("chunk_start"), (F.col("start_time") + 4).alias("chunk_end"), F.lit(0.2).alias("start_time"), (F.col("end_time") - F.col("start_time") + F.lit(0.4)).alias("end_time"), "text")
    return rounded(transcript.recognised(raw), "start_time", "end_time")


# ---- fusion and decoding ---------------------------------------------------------------------------------------------


def _log(p: str) -> str:
    return f"ln(least(greatest({p}, 1e-6::double), 1 - 1e-6::double))"


def fuse_sql(vad="vad", a="diar_a", b="diar_b", leak="leak", recall=False) -> str:
    speech, quiet = _log(vad), _log(f"1 - {vad}")
    return f"""select rec, frame, {quiet}{' + -1::double' if recall else ''} as s_sil, {speech} + {_log(a)} as s_a, {speech} + {_log(b)} as s_b,
    {speech} + 1.5::double * ({_log(a)} + {_log(b)}) + 0.4::double as s_ovl, {_log(leak) if leak else '0::double'} + 0.5::double * {quiet} + -3::double as s_leak from frames"""


def _shown(sql: str) -> str:
    return "select rec, frame, " + ", ".join(f"round({s}, 6) + 0 as {s}" for s in fusion.SCORES) + f" from ({sql})"


@query(f"with {T.FRAMES} {_shown(fuse_sql())}")
def fuse_balanced(spark, d):
    return rounded(fusion.fuse(T.frames(spark, d)), *fusion.SCORES)


@query(f"with {T.FRAMES} {_shown(fuse_sql(recall=True))}")
def fuse_high_recall(spark, d):
    return rounded(fusion.fuse(T.frames(spark, d), HIGH_RECALL), *fusion.SCORES)


@query(f"with {T.FRAMES} {_shown(fuse_sql(a='0.5::double', b='0.5::double', leak=''))}")
def fuse_missing_tracks(spark, d):
    return rounded(fusion.fuse(T.frames(spark, d).select("rec", "frame", "vad")), *fusion.SCORES)


@query(f"""with {T.FRAMES} select rec, frame, round({_log('vad')} + {_log('diar_a')} + 0.4::double * (rec % 3), 6) + 0 as s_a, round({_log('vad')} + {_log('diar_b')} + 0.4::double * -(rec % 2), 6) + 0 as s_b from frames""")
def fuse_prior(spark, d):
    f = T.frames(spark, d).withColumn("prior_a", (F.col("rec") % 3).cast("double")).withColumn("prior_b", -(F.col("rec") % 2).cast("double"))
    return rounded(fusion.fuse(f).select("rec", "frame", "s_a", "s_b"), "s_a", "s_b")


def _matrix(tuning: dec.Tuning = dec.Tuning()) -> str:
    return ", ".join(f"('{i}', '{j}', {'null' if v == dec.NEVER else v}::double)" for (i, j), v in dec.penalties(tuning).items())


@query("select * from (values ('SIL','SIL',0::double),('SIL','A',-4),('SIL','B',-4),('SIL','OVL',-4),('SIL','LEAK',null),('A','SIL',-3.5),('A','A',0),('A','B',-6),('A','OVL',-3),('A','LEAK',-2),('B','SIL',-3.5),('B','A',-6),('B','B',0),('B','OVL',-3),('B','LEAK',-2),('OVL','SIL',-3.5),('OVL','A',-3),('OVL','B',-3),('OVL','OVL',0),('OVL','LEAK',-2),('LEAK','SIL',-1),('LEAK','A',null),('LEAK','B',null),('LEAK','OVL',-5),('LEAK','LEAK',0)) t(from_state, to_state, penalty)")
def transition_matrix(spark, d):
    return dec.step_table(spark)


def viterbi_sql(scores: str, tuning: dec.Tuning = dec.Tuning(), least: dict[str, int] | None = None) -> str:
    """Dynamic programming over frames as a recursive query; scores: rec, frame and the five scores, as a CTE named scores."""
    m = dec.model(tuning, least)
    k = len(m.base)
    trans = ", ".join(f"({i}, {j}, {m.step[i, j]}::double)" for i in range(k) for j in range(k) if m.step[i, j] != dec.NEVER)
    subs = ", ".join(f"({j}, {m.base[j]}, {'null' if m.first[j] == dec.NEVER else m.first[j]}::double)" for j in range(k))
    return f"""with recursive {scores},
em as materialized (select rec, frame as t, b - 1 as b, [s_sil, s_a, s_b, s_ovl, s_leak][b] as e from scores, (values (1), (2), (3), (4), (5)) x(b)),
tr(i, j, w) as (values {trans}), st(j, b, init) as (values {subs}),
dp(rec, t, j, score, bp) as (
 select em.rec, 0::bigint, st.j, st.init + em.e, -1 from em join st using (b) where t = 0 and st.init is not null
 union all
 select rec, t, j, score, bp from (select d.rec, d.t + 1 as t, tr.j, d.score + tr.w + em.e as score, d.j as bp, row_number() over (partition by d.rec, tr.j order by d.score + tr.w desc, d.j) as n
  from dp d join tr on tr.i = d.j join st on st.j = tr.j join em on em.rec = d.rec and em.t = d.t + 1 and em.b = st.b) where n = 1),
held as materialized (select * from dp), ends as (select rec, max(t) as mt from held group by rec),
path(rec, t, j, bp) as (
 select rec, t, j, bp from (select h.*, row_number() over (partition by h.rec order by score desc, j) as n from held h join ends e on h.rec = e.rec and h.t = e.mt) where n = 1
 union all select h.rec, h.t, h.j, h.bp from path p join held h on h.rec = p.rec and h.t = p.t - 1 and h.j = p.bp)
select p.rec, p.t as frame, {list(dec.STATES)}[st.b + 1] as state from path p join st using (j)"""


ROUNDED = ", ".join(f"round({s}, 9) as {s}" for s in fusion.SCORES)


def _nine(scores: DataFrame) -> DataFrame:
    """Scores to nine digits: the two engines' logarithms differ in the last bit, and equal scores must tie in both."""
    return scores.select("rec", "frame", *(F.round(s, 9).alias(s) for s in fusion.SCORES))


def _fused_path(spark, d, tuning: dec.Tuning = dec.Tuning()) -> DataFrame:
    return dec.decode(_nine(fusion.fuse(T.frames(spark, d), tuning)), tuning)


@query(viterbi_sql(f"{T.FRAMES}, scores as (select rec, frame, {ROUNDED} from ({fuse_sql()}))"))
def viterbi_path(spark, d):
    return _fused_path(spark, d)


@query(viterbi_sql(f"{T.FRAMES}, scores as (select rec, frame, {ROUNDED} from ({fuse_sql(recall=True)}))", HIGH_RECALL))
def viterbi_high_recall(spark, d):
    return _fused_path(spark, d, HIGH_RECALL)


def raw_path(spark, d) -> DataFrame:
    return dec.decode(T.raw_scores(spark, d))


@query(viterbi_sql(T.RAW_SCORES))
def viterbi_raw(spark, d):
    return raw_path(spark, d)


@query(f"with {T.EVENT_STATES}, b as (select *, lag(state) over (partition by rec order by frame) as p from states) select rec, count(*) filter (p = 'LEAK' and state not in ('LEAK', 'SIL')) as ipu_start_after_leak from b group by rec")
def leak_starts(spark, d):
    return dec.counters(T.event_states(spark, d))


@query(f"""with {T.FRAMES}, {LONG}, held as (select * from long where not (rec % 5 = 0 and track = 'leak' and frame >= 50)), per as (select rec, track, count(distinct frame) as n, max(frame) as last from held group by rec, track)
select rec, min(n) as least, max(n) as most, max(last) as last from per group by rec having min(n) <> max(n) or max(last) + 1 <> max(n)""")
def grid_check(spark, d):
    """Recordings whose tracks do not have the same frames."""
    return fusion.incomplete(_long(T.frames(spark, d)).where(~((F.col("rec") % 5 == 0) & (F.col("track") == "leak") & (F.col("frame") >= 50))))


@query(f"with {T.FRAMES} " + _shown(fuse_sql(vad="(1 / (1 + exp(-(vad * 4 - 2))))")))
def fuse_logits(spark, d):
    f = T.frames(spark, d).withColumn("vad", F.col("vad") * 4 - 2)
    return rounded(fusion.fuse(f, logits=("vad",)), *fusion.SCORES)


# ---- segments --------------------------------------------------------------------------------------------------------

RUNS = f"""{T.EVENT_STATES}, islands as (select *, frame - row_number() over (partition by rec, state order by frame) as g from states),
runs as (select rec, state, min(frame) as first, max(frame) as last from islands group by rec, state, g)"""
IPUS = f"{RUNS}, ipus as (select rec, state as label, first * 0.01::double as start_time, (last + 1) * 0.01::double as end_time from runs where (last + 1 - first) * 0.01::double >= 0.02::double)"


def _ipus(spark, d) -> DataFrame:
    return segments.ipus(T.event_states(spark, d), 0.02)


@query(f"with {IPUS} select rec, label, round(start_time, 6) as start_time, round(end_time, 6) as end_time from ipus")
def ipu_extract(spark, d):
    return rounded(_ipus(spark, d), "start_time", "end_time")


MERGED = """fresh as (select *, case when label = lag(label) over w and start_time - lag(end_time) over w < 0.04::double then 0 else 1 end as f from ipus window w as (partition by rec order by start_time, end_time, label)),
grouped as (select *, sum(f) over (partition by rec order by start_time, end_time, label) as g from fresh),
merged as (select rec, min(label) as label, min(start_time) as start_time, arg_max(end_time, start_time) as end_time from grouped group by rec, g)"""


@query(f"with {IPUS}, {MERGED} select rec, label, round(start_time, 6) as start_time, round(end_time, 6) as end_time from merged")
def ipu_merge(spark, d):
    return rounded(segments.merge_gaps(_ipus(spark, d), 0.04), "start_time", "end_time")


@query(f"""with {IPUS}, fresh as (select *, case when label in ('A', 'B', 'OVL') and start_time - lag(end_time) over w < 0.04::double then 0 else 1 end as f from ipus window w as (partition by rec, label order by start_time)),
grouped as (select *, sum(f) over (partition by rec, label order by start_time) as g from fresh)
select rec, label, round(min(start_time), 6) as start_time, round(arg_max(end_time, start_time), 6) as end_time from grouped group by rec, label, g""")
def ipu_merge_per_label(spark, d):
    return rounded(segments.merge_per_label(_ipus(spark, d), 0.04), "start_time", "end_time")


@query(f"with {T.EVENT_STATES}, b as (select *, lag(state) over (partition by rec order by frame) as p from states) select rec, round(frame * 0.01::double, 6) as time_s from b where p <> state")
def state_boundaries(spark, d):
    return rounded(segments.boundaries(T.event_states(spark, d)), "time_s")


@query(f"""with {T.TURNS}, lens as (select rec, ceil(max(end_time) / 0.1::double)::bigint as n from turns group by rec),
grid as (select rec, unnest(range(0, n)) as frame from lens),
spans as (select rec, label, trunc(start_time / 0.1::double)::bigint as a, trunc(end_time / 0.1::double)::bigint as b from turns where label <> 'SIL')
select g.rec, g.frame, coalesce(arg_min(label, case label when 'OVL' then 0 when 'LEAK' then 1 when 'A' then 2 else 3 end) filter (label is not null), 'SIL') as state from grid g left join spans s on s.rec = g.rec and g.frame >= s.a and g.frame < s.b group by g.rec, g.frame""")
def rasterize(spark, d):
    t = T.turns(spark, d)
    lens = t.groupBy("rec").agg(F.ceil(F.max("end_time") / F.lit(0.1)).alias("n_frames"))
    return segments.rasterize(t, lens, 0.1)


_GAP = """cur as (select *, coalesce(lag(end_time) over (partition by rec order by start_time, end_time, label), 0::double) as c from turns)"""


@query(f"""with {T.TURNS}, {_GAP} select rec, start_time, end_time, label from cur union all select rec, c, start_time, '#' from cur where start_time > c""")
def gap_fill(spark, d):
    return segments.fill_gaps(T.turns(spark, d).select("rec", "start_time", "end_time", "label"))


@query(f"""with {IPUS}, t as (select rec, count(*) filter (label in ('A', 'B', 'OVL')) as total_ipus, count(*) filter (label = 'LEAK') as leak_segments from ipus group by rec),
b as (select *, lag(state) over (partition by rec order by frame) as p from states), c as (select rec, count(*) filter (p = 'LEAK' and state not in ('LEAK', 'SIL')) as n from b group by rec)
select c.rec, n as ipu_start_after_leak, coalesce(total_ipus, 0)::bigint as total_ipus, coalesce(leak_segments, 0)::bigint as leak_segments from c left join t using (rec)""")
def run_counters(spark, d):
    return metrics.run_counters(T.event_states(spark, d), _ipus(spark, d))


# ---- metrics ---------------------------------------------------------------------------------------------------------


def _shifted(states: DataFrame) -> DataFrame:
    """A second path to compare with: each state two frames late where the recording is even, else with every seventh frame
    silent."""
    late = F.coalesce(F.lag("state", 2).over(segments.by_frame()), F.lit("SIL"))
    return states.select("rec", "frame", F.when(F.col("rec") % 2 == 0, late).when(F.col("frame") % 7 == 0, F.lit("SIL")).otherwise(F.col("state")).alias("state"))


HYP = f"{T.EVENT_STATES}, hyp as (select rec, frame, case when rec % 2 = 0 then coalesce(lag(state, 2) over (partition by rec order by frame), 'SIL') when frame % 7 = 0 then 'SIL' else state end as state from states)"


def boundary_sql(tol: float) -> str:
    return f"""with recursive {HYP},
r as (select rec, x, row_number() over (partition by rec order by x) - 1 as i from (select rec, frame * 0.01::double as x, state, lag(state) over (partition by rec order by frame) as p from states) where p <> state),
h as (select rec, x, row_number() over (partition by rec order by x) - 1 as i from (select rec, frame * 0.01::double as x, state, lag(state) over (partition by rec order by frame) as p from hyp) where p <> state),
m(rec, i, used, tp) as (select distinct rec, -1::bigint, -1::bigint[], 0::bigint from h where false
 union all select rec, i, used, tp from (select distinct rec, -1::bigint as i, []::bigint[] as used, 0::bigint as tp from h) where false),
w(rec, i, used) as (select distinct rec, -1::bigint, []::bigint[] from h
 union all select rec, i, case when ri is null then used else list_append(used, ri) end from (
  select w.rec, h.i, w.used, r.i as ri, row_number() over (partition by w.rec order by (r.i is null), abs(r.x - h.x), r.i) as n from w join h on h.rec = w.rec and h.i = w.i + 1
  left join r on r.rec = w.rec and abs(r.x - h.x) <= {tol}::double and not list_contains(w.used, r.i)) where n = 1),
hits as (select rec, len(arg_max(used, i)) as tp from w group by rec),
counts as (select s.rec, coalesce(any_value(tp), 0) as tp, (select count(*) from r where r.rec = s.rec) as nr, (select count(*) from h where h.rec = s.rec) as nh from (select distinct rec from states) s left join hits on hits.rec = s.rec group by s.rec)
select rec, tp::bigint as tp, (nh - tp)::bigint as fp, (nr - tp)::bigint as fn, round(case when nh + nr > 0 then 2 * tp / (nh + nr)::double else 0 end, 6) as f1 from counts""".replace(
        """m(rec, i, used, tp) as (select distinct rec, -1::bigint, -1::bigint[], 0::bigint from h where false
 union all select rec, i, used, tp from (select distinct rec, -1::bigint as i, []::bigint[] as used, 0::bigint as tp from h) where false),
""",
        "",
    )


@query(boundary_sql(0.05))
def boundary_f1(spark, d):
    s = T.event_states(spark, d)
    out = metrics.boundary_scores(segments.boundaries(s), segments.boundaries(_shifted(s)), 0.05, s.select("rec"))
    return rounded(out.select("rec", "tp", "fp", "fn", "f1"), "f1")


_IOU = "case when count(*) filter (s.state in {0} or h.state in {0}) = 0 then 1::double else count(*) filter (s.state in {0} and h.state in {0}) / (count(*) filter (s.state in {0} or h.state in {0}))::double end"
IOUS = ", ".join(f"{_IOU.format(str(v))} as {k}" for k, v in metrics.MASKS.items())


@query(f"with {HYP}, all_ as (select s.rec, {IOUS} from states s join hyp h on s.rec = h.rec and s.frame = h.frame group by s.rec) select rec, round(iou_a, 6) as iou_a, round(iou_b, 6) as iou_b, round(iou_any, 6) as iou_any from all_")
def framewise_iou(spark, d):
    s = T.event_states(spark, d)
    return rounded(metrics.framewise(s, _shifted(s)), *metrics.MASKS)


@query(f"""with {IPUS}, total as (select rec, count(*) * 0.01::double as s from states group by rec) select t.rec, round((select count(*) from ipus i where i.rec = t.rec and end_time - start_time < 0.035::double) / (s / 60), 6) as micro_ipus_per_min from total t""")
def micro_ipus(spark, d):
    s = T.event_states(spark, d)
    total = s.groupBy("rec").agg((F.count("*") * F.lit(0.01)).alias("total_s"))
    return rounded(metrics.micro_ipus(segments.ipus(s, 0.02), total, 0.035), "micro_ipus_per_min")


SWITCHES = "case when s > 0 then n / (s / 60) else 0 end"


@query(f"""with {T.EVENT_STATES}, sp as (select rec, state, lag(state) over (partition by rec order by frame) as p from states where state in ('A', 'B')),
n as (select rec, count(*) filter (p <> state) as n from sp group by rec), t as (select rec, count(*) * 0.01::double as s from states group by rec)
select t.rec, round(coalesce(n, 0) / (s / 60), 6) as switches_per_min from t left join n using (rec)""")
def speaker_switches(spark, d):
    return rounded(metrics.speaker_switches(T.event_states(spark, d)), "switches_per_min")


@query(f"""with {T.EVENT_STATES}, l as (select *, lead(state) over w as b, lead(state, 2) over w as c from states window w as (partition by rec order by frame))
select rec, count(*) filter (state in ('A', 'B') and b in ('A', 'B') and state <> b and state = c) as rapid_alternations, count(*) as n_frames from l group by rec""")
def rapid_alternations(spark, d):
    return metrics.rapid_alternations(T.event_states(spark, d))


# ---- recogniser windows and transcripts ------------------------------------------------------------------------------


def chunks_sql() -> str:
    """The three passes as recursive queries, a step a unit: split segments, joined units, windows of joined units."""
    c = chunking
    k = "k.rec, k.label"
    return f"""with recursive {T.TURNS}, ends as (select rec, max(end_time) as duration from turns where label <> 'SIL' group by rec),
ipus as (select rec, label, start_time as s, end_time as e, row_number() over (partition by rec, label order by start_time, end_time) - 1 as ipu from turns where label <> 'SIL'),
pieces as (select rec, label, ipu, case when e - s > {c.SPLIT_OVER} then s + {c.TARGET} * j else s end as s, case when e - s > {c.SPLIT_OVER} then least(s + {c.TARGET} * (j + 1), e) else e end as e
 from (select *, unnest(range(0, case when e - s > {c.SPLIT_OVER} then ceil((e - s) / {c.TARGET})::bigint else 1 end)) as j from ipus where e - s >= {c.MIN_IPU})),
units as materialized (select *, row_number() over (partition by rec, label order by ipu, s) - 1 as i from pieces),
fold(rec, label, i, g, gs, ge) as (select rec, label, i, 0, s, e from units where i = 0
 union all select {k}, k.i, case when ge - gs < {c.MIN_CHUNK} or k.e - gs <= {c.TARGET} then g else g + 1 end, case when ge - gs < {c.MIN_CHUNK} or k.e - gs <= {c.TARGET} then gs else k.s end, k.e from fold f join units k on k.rec = f.rec and k.label = f.label and k.i = f.i + 1),
parts as materialized (select f.rec, f.label, g as i, min(gs) as s, max_by(ge, f.i) as e, list(ipu) as own from fold f join units u on u.rec = f.rec and u.label = f.label and u.i = f.i group by f.rec, f.label, g),
core(rec, label, i, g, gs, ge, grown) as (select rec, label, i, 0, s, e, false from parts where i = 0
 union all select rec, label, i, case when more then g else g + 1 end, case when more then gs else s end, e, more from
 (select {k}, k.i, g, gs, k.s, k.e, k.e - gs <= {c.LONGEST} and not (grown and ge - gs >= {c.TARGET}) as more from core f join parts k on k.rec = f.rec and k.label = f.label and k.i = f.i + 1)),
cores as (select f.rec, f.label, g, min(gs) as s, max_by(ge, f.i) as e, list_sort(list_distinct(flatten(list(own)))) as own from core f join parts u on u.rec = f.rec and u.label = f.label and u.i = f.i group by f.rec, f.label, g),
roomy as (select cores.*, duration, greatest(0::double, {c.LONGEST} - (e - s)) as room from cores join ends using (rec)),
lefts as (select *, least({c.OVERLAP}::double, s, room / 2) as l from roomy)
select rec, label, g::bigint as chunk_idx, round(s - l, 6) as start_time, round(e + least({c.OVERLAP}::double, greatest(0::double, duration - e), room - l), 6) as end_time, array_to_string(own, ',') as ipu_indices from lefts"""


@query(chunks_sql())
def asr_chunks(spark, d):
    t = T.turns(spark, d).where("label <> 'SIL'")
    timed = t.withColumn("duration_s", F.max("end_time").over(W.partitionBy("rec")))
    found = chunking.asr_chunks(timed.select("rec", "label", "start_time", "end_time", "duration_s"))
    return rounded(found.withColumn("ipu_indices", F.array_join("ipu_indices", ",")), "start_time", "end_time")


def _doubled_words(spark, d) -> DataFrame:
    """The words of all turns, and again those of every third turn a little later, as overlapping windows give them."""
    w = T.words(spark, d).select("rec", "word", "start_time", "end_time", "speaker", "turn")
    again = w.where("turn % 3 = 0").withColumn("start_time", F.col("start_time") + F.lit(0.0002)).withColumn("end_time", F.col("end_time") + F.lit(0.0002))
    return w.unionByName(again).drop("turn")


DOUBLED = f"""{T.TURNS}, {T.WORDS}, doubled as (select rec, word, start_time, end_time, speaker from words union all select rec, word, start_time + 0.0002::double, end_time + 0.0002::double, speaker from words where turn % 3 = 0),
ranked as (select *, row_number() over (partition by rec, word, round_even(start_time / 0.001::double, 0), round_even(end_time / 0.001::double, 0), speaker order by start_time, end_time) as n from doubled)"""


@query(f"with {DOUBLED} select rec, word, round(start_time, 6) as start_time, round(end_time, 6) as end_time, speaker from ranked where n = 1")
def word_dedupe(spark, d):
    return rounded(transcript.deduplicate(_doubled_words(spark, d)), "start_time", "end_time")


@query(f"""with {T.TURNS}, {T.WORDS}, ipus as (select rec, turn as ipu, label, start_time + 0.5::double as start_time, end_time + 0.5::double as end_time from turns where label <> 'SIL'),
ranked as (select *, row_number() over (partition by rec, word, round_even(start_time / 0.001::double, 0), round_even(end_time / 0.001::double, 0), speaker order by start_time, end_time) as n from words),
pairs as (select i.*, w.word, w.start_time as ws, w.end_time as we, coalesce(w.speaker, '') as sp from ipus i join ranked w on w.n = 1 and w.rec = i.rec and least(w.end_time, i.end_time) > greatest(w.start_time, i.start_time))
select rec, ipu, label, round(start_time, 6) as start_time, round(end_time, 6) as end_time, count(*) as n_words, string_agg(word, ' ' order by ws, we, encode(word), sp) as text from pairs group by all""")
def align_words(spark, d):
    shift = lambda c: (F.col(c) + F.lit(0.5)).alias(c)
    ipus = T.turns(spark, d).where("label <> 'SIL'").select("rec", F.col("turn").alias("ipu"), "label", shift("start_time"), shift("end_time"))
    return rounded(transcript.align(T.words(spark, d).select("rec", "word", "start_time", "end_time", "speaker"), ipus), "start_time", "end_time")


@query(f"""with {T.TURNS} select rec, start_time, end_time, text, speaker, row_number() over (partition by rec order by start_time, end_time, coalesce(speaker, ''), encode(text)) - 1 as "order" from (select rec, start_time, end_time, text, case when label <> 'SIL' then label end as speaker from turns)""")
def merge_transcripts(spark, d):
    t = T.turns(spark, d)
    parts = [transcript.assign_speaker(t.where(F.col("label") == s), F.lit(s)).select("rec", "start_time", "end_time", "text", "speaker") for s in ("A", "B")]
    rest = transcript.assign_speaker(t.where("label = 'SIL'"), F.lit(None).cast("string")).select("rec", "start_time", "end_time", "text", "speaker")
    return transcript.merge(*parts, rest)


@query(f"""with {T.TURNS}, seen as (select rec, start_time, end_time, text from turns union all select rec, start_time, end_time, text from turns where turn % 2 = 0), l as (select *, lag(start_time) over w as ps, lag(end_time) over w as pe, lag(text) over w as pt from seen where trim(text) <> '' window w as (partition by rec order by start_time, end_time, encode(text)))
select rec, start_time, end_time, text from l where not coalesce(abs(start_time - ps) < 1e-6 and abs(end_time - pe) < 1e-6 and text = pt, false)""")
def merge_adjacent(spark, d):
    t = T.turns(spark, d).select("rec", "turn", "start_time", "end_time", "text")
    return transcript.merge_adjacent(t.unionByName(t.where("turn % 2 = 0")).drop("turn"))


# ---- evaluation ------------------------------------------------------------------------------------------------------

TIER = "case rec % 3 when 0 then 'easy' when 1 then 'hard' else 'synthetic' end"


def _card(spark, d, factor: float = 1.0) -> DataFrame:
    """One row per recording of frames: metrics as plain figures of its tracks."""
    tier = F.when(F.col("rec") % 3 == 0, "easy").when(F.col("rec") % 3 == 1, "hard").otherwise("synthetic")
    f = T.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("rec")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.avg("l_quantity").alias("c"), F.count("*").alias("n"))
    figures = f.select(F.col("rec").alias("id"), tier.alias("tier"), F.when(F.col("rec") % 10 == 9, "failed").otherwise("ok").alias("status"), (F.col("a") * 10).alias("boundary_f1_20ms"), (F.col("b") * 12.5).alias("boundary_f1_50ms"), (F.col("c") * factor).alias("micro_ipus_per_min"), (F.col("n") / 100.0).alias("switches_per_min"))
    zero = lambda m: F.when(F.col("status") == "ok", F.col(m)).otherwise(F.lit(0.0)).alias(m)
    return figures.select("id", "tier", "status", *(zero(m) for m in evaluation.METRICS))


def card_sql(name: str, factor: str) -> str:
    zero = "case when rec % 10 <> 9 then {} else 0 end as {}"
    body = ", ".join(zero.format(e, m) for e, m in zip(("a * 10", "b * 12.5::double", f"c * {factor}", "n / 100::double"), evaluation.METRICS))
    return f"""{name} as (select rec as id, {TIER} as tier, case when rec % 10 = 9 then 'failed' else 'ok' end as status, {body} from (select l_suppkey as rec, avg(l_discount) as a, avg(l_tax) as b, avg(l_quantity) as c, count(*) as n from lineitem group by 1))"""


_CARD = card_sql("card", "1::double")


@query(f"with {_CARD} select tier, count(*) as n, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in evaluation.METRICS) + " from card group by rollup (tier)")
def scorecard_by_tier(spark, d):
    return rounded(evaluation.by_tier(_card(spark, d)), *evaluation.METRICS)


@query(f"with {_CARD} select id, tier, status, " + ", ".join(f"round({m}, 6) as {m}" for m in evaluation.METRICS) + " from card")
def scorecard(spark, d):
    return rounded(_card(spark, d), *evaluation.METRICS)


def _perturbed(spark, d) -> DataFrame:
    c = _card(spark, d, 1.1)
    k = F.col("id") % 7
    return c.withColumn("boundary_f1_20ms", F.col("boundary_f1_20ms") + F.when(k == 3, F.lit(0.02)).when(k == 5, F.lit(-0.02)).otherwise(F.lit(0.0))).withColumn("switches_per_min", F.col("switches_per_min") * F.when(k == 3, F.lit(1.6)).when(k == 6, F.lit(1.3)).otherwise(F.lit(1.0)))


_CURRENT = f"""{card_sql('plain', '1.1::double')}, cur as (select id, tier, status, boundary_f1_20ms + case id % 7 when 3 then 0.02::double when 5 then -0.02::double else 0 end as boundary_f1_20ms, boundary_f1_50ms, micro_ipus_per_min, switches_per_min * case id % 7 when 3 then 1.6::double when 6 then 1.3::double else 1 end as switches_per_min from plain)"""
_DELTA = f"{_CARD}, {_CURRENT}, delta as (select c.id, c.tier, " + ", ".join(f"b.{m} as {m}_baseline, c.{m} as {m}_current, c.{m} - b.{m} as {m}_delta" for m in evaluation.METRICS) + " from card b join cur c on b.id = c.id where b.status = 'ok' and c.status = 'ok')"


def _delta(spark, d) -> DataFrame:
    ok = lambda c: evaluation.latest(c, F.col("id"))
    return evaluation.deltas(ok(_card(spark, d)), ok(_perturbed(spark, d)))


_DELTA_NAMES = [f"{m}_{k}" for m in evaluation.METRICS for k in ("baseline", "current", "delta")]


@query(f"with {_DELTA} select id, tier, " + ", ".join(f"round({n}, 6) + 0 as {n}" for n in _DELTA_NAMES) + " from delta")
def delta_report(spark, d):
    return rounded(_delta(spark, d), *_DELTA_NAMES)


@query(f"with {_DELTA} select tier, count(*) as n, " + ", ".join(f"round(avg({m}_delta), 6) + 0 as {m}_delta" for m in evaluation.METRICS) + " from delta group by rollup (tier)")
def delta_summary(spark, d):
    return rounded(evaluation.delta_summary(_delta(spark, d)), *(f"{m}_delta" for m in evaluation.METRICS))


_GREW = "{0}_current > greatest({0}_baseline, 1e-9::double) * {1}::double"


@query(f"""with {_DELTA}
select id, 'failure' as kind, 'boundary_f1_20ms drop' as rule from delta where tier = 'easy' and boundary_f1_20ms_delta < -0.01::double
union all select id, 'failure', 'boundary_f1_50ms drop' from delta where tier = 'easy' and boundary_f1_50ms_delta < -0.01::double
union all select id, 'failure', 'switches_per_min increase' from delta where tier = 'easy' and {_GREW.format('switches_per_min', 1.25)}
union all select id, 'failure', 'micro_ipus_per_min increase' from delta where tier = 'easy' and {_GREW.format('micro_ipus_per_min', 1.25)}
union all select id, 'warning', 'suspicious improvement' from delta where tier = 'hard' and boundary_f1_20ms_delta > 0 and ({_GREW.format('switches_per_min', 1.5)} or {_GREW.format('micro_ipus_per_min', 1.5)})
union all select null, 'failure', 'UNEXPLAINED' from (select max(greatest({', '.join(f'abs({m}_delta)' for m in evaluation.METRICS)})) as m from delta) where m > 1e-9""")
def guardrails(spark, d):
    return evaluation.findings(_delta(spark, d), params_changed=False)


@query(f"""with {_DELTA}, {card_sql('card2', '1.2::double')}, delta2 as (select c.id, c.tier, {', '.join(f'c.{m} - b.{m} as {m}_delta' for m in evaluation.METRICS)} from card b join card2 c on b.id = c.id where b.status = 'ok'),
board as (select 0 as candidate, * from (select tier, {', '.join(f'{m}_delta' for m in evaluation.METRICS)} from delta) union all select 1, * from (select tier, {', '.join(f'{m}_delta' for m in evaluation.METRICS)} from delta2)),
rows_ as (select candidate::int as candidate, round(coalesce(avg(micro_ipus_per_min_delta) filter (tier = 'hard'), 0), 6) + 0 as hard_micro_ipus_per_min_delta, round(coalesce(avg(boundary_f1_20ms_delta) filter (tier = 'easy'), 0), 6) + 0 as easy_boundary_f1_20ms_delta, round(avg(switches_per_min_delta), 6) + 0 as switches_per_min_delta from board group by candidate)
select *, row_number() over (order by hard_micro_ipus_per_min_delta, abs(easy_boundary_f1_20ms_delta), switches_per_min_delta, candidate)::int as place from rows_""")
def leaderboard(spark, d):
    other = evaluation.deltas(evaluation.latest(_card(spark, d), F.col("id")), evaluation.latest(_card(spark, d, 1.2), F.col("id")))
    return evaluation.leaderboard(evaluation.board_row(0, _delta(spark, d), 6).unionByName(evaluation.board_row(1, other, 6)))


@query(f"with {_CARD} select id, tier, status from card where id in (1, 5) or lower(tier) = 'hard'")
def suite_filter(spark, d):
    return evaluation.suite(_card(spark, d), ("1", "5", "Hard")).select("id", "tier", "status")


NO_LEAST = {name: 1 for name in dec.STATES}


def _path_scores(spark, d) -> DataFrame:
    """Metrics of the decoded path (1) against a reference (0), the same scores decoded without least durations, a few frames
    shorter; both are decoded in one pass. A recording of which the reference keeps nothing has no metrics."""
    both = dec.decode_all(T.raw_scores(spark, d), {0: dec.model(least=NO_LEAST), 1: dec.model()}).withColumnRenamed("candidate", "path")
    sized = metrics.side_by_side(both).withColumn("n", F.count("*").over(W.partitionBy("rec", "path")) - F.col("rec") % 5)
    return metrics.path_scores(sized.where("n > 0 and (path = 1 or frame < n)"), least_s=0.03)


def _matched(tol: str, name: str) -> str:
    """Recursive match of the boundaries h, in order, each with the nearest of r that is left within tol."""
    return f"""{name}(rec, i, used) as (select distinct rec, -1::bigint, []::bigint[] from h
 union all select rec, i, case when ri is null then used else list_append(used, ri) end from (
  select w.rec, h.i, w.used, r.i as ri, row_number() over (partition by w.rec order by (r.i is null), abs(r.x - h.x), r.i) as n from {name} w join h on h.rec = w.rec and h.i = w.i + 1
  left join r on r.rec = w.rec and abs(r.x - h.x) <= {tol}::double and not list_contains(w.used, r.i)) where n = 1)"""


def _edges(name: str, table: str) -> str:
    return f"{name} as materialized (select rec, x, row_number() over (partition by rec order by x) - 1 as i from (select rec, frame * 0.01::double as x, state, lag(state) over (partition by rec order by frame) as p from {table}) where p <> state)"


def _f1(name: str, tol: str) -> str:
    tp = f"coalesce((select len(arg_max(used, i)) from {name} w where w.rec = c.rec), 0)"
    both = "((select count(*) from h where h.rec = c.rec) + (select count(*) from r where r.rec = c.rec))"
    return f"case when {both} > 0 then 2 * {tp} / {both}::double else 0 end as boundary_f1_{tol}"


def _scores_sql() -> str:
    return f"""hyp0 as materialized ({viterbi_sql(T.RAW_SCORES)}),
ref0 as materialized (select rec, frame, state from (select *, count(*) over (partition by rec) as n from ({viterbi_sql(T.RAW_SCORES, least=NO_LEAST)})) where frame < n - rec % 5),
cut as materialized (select rec, least((select count(*) from ref0 r where r.rec = h.rec), count(*)) as n from hyp0 h group by rec),
states as materialized (select s.* from ref0 s join cut using (rec) where frame < n), hyp as materialized (select s.* from hyp0 s join cut using (rec) where frame < n),
{_edges('r', 'states')}, {_edges('h', 'hyp')}, {_matched('0.02', 'w20')}, {_matched('0.05', 'w50')},
ious as (select s.rec, {IOUS} from states s join hyp h on s.rec = h.rec and s.frame = h.frame group by s.rec),
islands as (select *, frame - row_number() over (partition by rec, state order by frame) as g from hyp0),
micro as (select rec, count(*) as n from (select rec, state, (max(frame) + 1) * 0.01::double - min(frame) * 0.01::double as d, count(*) as k from islands group by rec, state, g) where k * 0.01::double >= 0.03::double and d < 0.2::double group by rec),
turned as (select rec, count(*) filter (p <> state) as n from (select rec, state, lag(state) over (partition by rec order by frame) as p from hyp where state in ('A', 'B')) group by rec),
rapid as (select rec, count(*) filter (state in ('A', 'B') and b in ('A', 'B') and state <> b and state = c) as n from (select *, lead(state) over w as b, lead(state, 2) over w as c from hyp window w as (partition by rec order by frame)) group by rec),
measured as (select c.rec, iou_a, iou_b, iou_any, {_f1('w20', '20ms')}, {_f1('w50', '50ms')}, coalesce(m.n, 0) / (c.n * 0.01::double / 60) as micro_ipus_per_min, coalesce(t.n, 0) / (c.n * 0.01::double / 60) as switches_per_min,
 a.n as rapid_alternations, a.n / greatest(c.n * 0.01::double / 60, 1e-9::double) as rapid_alternations_per_min from cut c join ious using (rec) left join micro m on m.rec = c.rec left join turned t on t.rec = c.rec join rapid a on a.rec = c.rec)"""


_SCORED = [*metrics.MASKS, "boundary_f1_20ms", "boundary_f1_50ms", "micro_ipus_per_min", "switches_per_min", "rapid_alternations_per_min"]


@query(f"with recursive {_scores_sql()} select rec, rapid_alternations, " + ", ".join(f"round({m}, 6) as {m}" for m in _SCORED) + " from measured")
def evaluate_paths(spark, d):
    """All metrics of the decoded path against the reference path, cut to the shorter of both."""
    return rounded(_path_scores(spark, d).drop("n_frames"), *_SCORED)


@query(f"with recursive {_scores_sql()} select {TIER} as tier, count(*) as n, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in evaluation.METRICS) + f" from measured group by rollup ({TIER})")
def evaluate_by_tier(spark, d):
    """The scorecard of those metrics by tier: decoding, matching and aggregation in one plan."""
    tier = F.when(F.col("rec") % 3 == 0, "easy").when(F.col("rec") % 3 == 1, "hard").otherwise("synthetic")
    return rounded(evaluation.by_tier(_path_scores(spark, d).withColumn("tier", tier)), *evaluation.METRICS)


@query(" union all ".join(f"select {k}::int as candidate, state, count(*) as n from ({viterbi_sql(T.RAW_SCORES, t)}) group by state" for k, t in enumerate(dec.GRID)))
def tuning_grid(spark, d):
    """Frames of each state for each candidate of the tuning grid, all decoded in one pass over the recordings."""
    both = dec.decode_all(T.raw_scores(spark, d), {k: dec.model(t) for k, t in enumerate(dec.GRID)})
    return both.groupBy("candidate", "state").agg(F.count("*").alias("n"))


# ---- tracks and documents --------------------------------------------------------------------------------------------


@query(f"with {T.FRAMES}, {LONG} select rec, track, frame, k, round(case when track = 'vad' and rec % 2 = 0 then 1 - value else value end, 6) + 0 as value, confidence from long")
def bundle_merge(spark, d):
    base = _long(T.frames(spark, d))
    other = base.where("track = 'vad' and rec % 2 = 0").withColumn("value", 1 - F.col("value"))
    return rounded(tracks.merge_bundles(base, other), "value")


@query(f"with {T.FRAMES}, {LONG} select rec, track, case track when 'diar_a' then 'speaker_a' when 'diar_b' then 'speaker_b' else 'vad' end as name, frame, round(value, 6) as value from long where track <> 'leak'")
def alias_select(spark, d):
    return rounded(tracks.by_alias(_long(T.frames(spark, d))).select("rec", "track", "name", "frame", "value"), "value")


@query(f"with {T.FRAMES} select rec, frame, round(vad, 6) as vad, round(leak, 6) as leak from frames")
def wide_frames(spark, d):
    return rounded(tracks.wide(_long(T.frames(spark, d)), ("vad", "leak")), "vad", "leak")


@query(f"""with {T.FRAMES}, {LONG}, bad as (select rec, track, case when rec % 5 = 0 and frame % 50 = 0 then value + 2 else value end as value from long where track in ('vad', 'leak'))
select rec, track, 'probability_range' as problem, count(*) filter (value > 1.001::double or value < -0.001::double) as n from bad group by rec, track having count(*) filter (value > 1.001::double or value < -0.001::double) > 0""")
def track_validation(spark, d):
    f = _long(T.frames(spark, d), ("vad", "leak")).withColumn("value", F.when((F.col("rec") % 5 == 0) & (F.col("frame") % 50 == 0), F.col("value") + 2).otherwise(F.col("value")))
    dim = f.select("rec", "track").distinct().select("rec", "track", F.lit("probability").alias("semantics"), F.lit(0.01).alias("hop_s"), F.lit(None).cast("long").alias("n_frames"))
    return tracks.violations(f, dim)


def _tiered(spark, d) -> DataFrame:
    tier = F.when(F.col("label") == "A", "SpeakerA").otherwise("SpeakerB")
    return T.turns(spark, d).where("label <> 'SIL'").select("rec", tier.alias("tier"), "start_time", "end_time", "label")


_NUM = "regexp_replace(printf('%.6f', {}), '\\.?0+$', '')"


@query(f"""with {T.TURNS}, seg as (select rec, case label when 'A' then 'SpeakerA' else 'SpeakerB' end as tier, start_time, end_time, label from turns where label <> 'SIL'),
ends as (select rec, max(end_time) as xmax from seg group by rec), tiers as (select rec, xmax, tier, place from ends, (values ('SpeakerA', 1), ('SpeakerB', 2), ('Overlap', 3), ('Leak', 4)) t(tier, place)),
cur as (select *, coalesce(lag(end_time) over (partition by rec, tier order by start_time, end_time), 0) as c from seg),
filled as (select rec, tier, start_time, end_time, label from cur union all select rec, tier, c, start_time, '#' from cur where start_time > c
 union all select t.rec, t.tier, coalesce(max(s.end_time), 0), xmax, '#' from tiers t left join seg s on s.rec = t.rec and s.tier = t.tier group by t.rec, t.tier, xmax having coalesce(max(s.end_time), 0) < xmax),
num as (select f.*, t.place, t.xmax, row_number() over (partition by f.rec, f.tier order by f.start_time, f.end_time, f.label) as i from filled f join tiers t on f.rec = t.rec and f.tier = t.tier),
blocks as (select rec, place, xmax, '    item [' || place || ']:' || chr(10) || '        class = "IntervalTier"' || chr(10) || '        name = "' || tier || '"' || chr(10) || '        xmin = 0' || chr(10) || '        xmax = ' || {_NUM.format('xmax')} || chr(10) || '        intervals: size = ' || count(*) || chr(10)
 || string_agg('        intervals [' || i || ']:' || chr(10) || '            xmin = ' || {_NUM.format('start_time')} || chr(10) || '            xmax = ' || {_NUM.format('end_time')} || chr(10) || '            text = "' || label || '"', chr(10) order by i) as block from num group by rec, place, tier, xmax)
select rec, 'File type = "ooTextFile"' || chr(10) || 'Object class = "TextGrid"' || chr(10) || chr(10) || 'xmin = 0' || chr(10) || 'xmax = ' || {_NUM.format('xmax')} || chr(10) || 'tiers? <exists>' || chr(10) || 'size = 4' || chr(10) || 'item []:' || chr(10) || string_agg(block, chr(10) order by place) as document from blocks group by rec, xmax""")
def textgrid_render(spark, d):
    return textgrid.render(_tiered(spark, d))


@query(f"with {T.TURNS} select rec, case label when 'A' then 'SpeakerA' else 'SpeakerB' end as tier, start_time, end_time, label from turns where label <> 'SIL'")
def textgrid_round_trip(spark, d):
    return textgrid.parse(textgrid.render(_tiered(spark, d)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, frames, fused scores, decoded path, segments, merged segments, counts per recording."""
    merged = segments.merge_per_label(segments.ipus(_fused_path(spark, sf_dir), 0.05), 0.4)
    count = lambda s: F.count_if(F.col("label") == s).alias(f"n_{s.lower()}")
    return merged.groupBy("rec").agg(*(count(s) for s in dec.STATES), F.round(F.sum(F.when(F.col("label") != "SIL", F.col("end_time") - F.col("start_time")).otherwise(F.lit(0.0))), 6).alias("speech_s"))


QUERIES["end_to_end"] = flagship
ORACLES["end_to_end"] = f"""with path as materialized ({viterbi_sql(f"{T.FRAMES}, scores as (select rec, frame, {ROUNDED} from ({fuse_sql()}))")}),
islands as (select *, frame - row_number() over (partition by rec, state order by frame) as g from path),
ipus as (select rec, state as label, min(frame) * 0.01::double as s, (max(frame) + 1) * 0.01::double as e from islands group by rec, state, g having count(*) * 0.01::double >= 0.05::double),
fresh as (select *, case when label in ('A', 'B', 'OVL') and s - lag(e) over w < 0.4::double then 0 else 1 end as f from ipus window w as (partition by rec, label order by s)),
grouped as (select *, sum(f) over (partition by rec, label order by s) as g from fresh),
merged as (select rec, label, min(s) as s, arg_max(e, s) as e from grouped group by rec, label, g)
select rec, {', '.join(f"count(*) filter (label = '{n}') as n_{n.lower()}" for n in dec.STATES)}, round(sum(case when label <> 'SIL' then e - s else 0 end), 6) as speech_s from merged group by rec"""
