"""Decisions on patches and the state that steers a run."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fixed values.
TYPE_THRESHOLDS = {"security": 0.8, "compile": 0.7, "syntax": 0.6, "dependency": 0.6, "runtime": 0.5, "lint": 0.3, "warning": 0.3, "info": 0.2, "unknown": 0.5}
REVIEW_PRIORITY = {"security": 1, "logic": 2, "type": 3, "import": 4, "syntax": 5, "formatting": 6, "unknown": 7}
REVIEW_CLASS = {"SECURITY": "security", "CRITICAL_SYNTAX": "syntax", "BLOCKING": "logic", "CLEANUP": "formatting", "UNKNOWN": "unknown"}
REVIEW_CODE = {
    "security": ("hardcoded_secret", "hardcoded_password", "sql_injection", "command_injection", "dangerous_eval", "unsafe_deserialization"),
    "logic": ("B904", "B006", "B008", "W503", "W504"), "type": ("import-untyped", "no-untyped-def", "ANN001", "ANN201", "ANN202"),
    "import": ("F401", "F811", "I001"), "syntax": ("E999", "invalid-syntax", "E902"),
}
GOVERNED = {"accept_threshold": 0.3, "exploration_rate": 0.4, "max_patch_size": 100.0, "max_iterations": 15.0, "rollback_limit": 3.0}


def review_category(code: Column, error_class: Column) -> Column:
    code, cls = F.trim(F.coalesce(code, F.lit(""))), F.upper(F.trim(F.coalesce(error_class, F.lit(""))))
    out = F.lit("unknown")
    for k, v in REVIEW_CLASS.items():
        out = F.when(cls == k, v).otherwise(out)
    for k, v in REVIEW_CODE.items():
        out = F.when(code.isin(*v), k).otherwise(out)
    return out


def review_priority(category: Column) -> Column:
    out = F.lit(7)
    for k, v in REVIEW_PRIORITY.items():
        out = F.when(category == k, v).otherwise(out)
    return out


def baseline_distance(weight: Column, compiles: Column, secure: Column, lint: Column, target_weight: float, target_lint: int) -> Column:
    """Mean of four distances from a healthy state, each 0 to 1."""
    far = lambda x, t, least: F.abs(x - t) / F.greatest(x, F.lit(t), F.lit(least))
    return (far(weight, target_weight, 1.0) + F.when(compiles, 0.0).otherwise(1.0) + F.when(secure, 0.0).otherwise(1.0) + far(lint, target_lint, 1)) / 4


def hard_constraint(security_ok: Column, found: Column, compiled_before: Column, compiles: Column, least: float = 0.7) -> Column:
    """ESCALATE for a sure, severe finding of a failed security check, REJECT for a build that broke, else null.  found: array of (confidence, severity)."""
    severe = F.exists(found, lambda x: (x["confidence"] > least) & x["severity"].isin("critical", "high"))
    return F.when(~security_ok & severe, "ESCALATE").when(compiled_before & ~compiles, "REJECT")


def soften(action: Column, strictness: Column) -> Column:
    """A strict policy takes the action, a middling one only escalations, a lax one none."""
    return F.when(action.isNull(), "ALLOW").when(strictness >= 1.0, action).when((strictness >= 0.5) & (action == "ESCALATE"), action).otherwise("ALLOW")


def evaluate(was_there: Column, still_there: Column, action: Column, score: Column, error_type: Column) -> Column:
    """ACCEPT if the target is gone, REJECT if it stays; else what the constraints or the type's threshold say."""
    limit = F.lit(0.5)
    for k, v in TYPE_THRESHOLDS.items():
        limit = F.when(error_type == k, v).otherwise(limit)
    return F.when(was_there & ~still_there, "ACCEPT").when(was_there & still_there, "REJECT").when(action.isin("REJECT", "ESCALATE"), action).when(score >= limit, "ACCEPT").when(score >= -limit, "RETRY").otherwise("REJECT")


def confidence_decision(confidence: Column, verdict: Column, safe: Column, generated: Column) -> Column:
    """ACCEPT at 0.85 (0.70 for safe codes, 0.95 in generated-looking files), REJECT when wrong or below 0.5."""
    limit = F.when(safe, 0.70).when(generated > 0.5, 0.95).otherwise(0.85)
    v, c = F.lower(F.coalesce(verdict, F.lit("ok"))), F.coalesce(confidence, F.lit(0.5))
    return F.when((v == "wrong") | (c < 0.5), "REJECT").when((c >= limit) & (v != "noisy"), "ACCEPT").otherwise("NEEDS_REVIEW")


def patch_score(known: Column, patch: Column, message: Column, history: Column) -> Column:
    """0.35 similarity to a known fix + 0.25 shared names + 0.20 fit of the kind + 0.20 history."""
    msg, p = F.lower(message), F.lower(patch)
    memory = F.when(known.isNull(), 0.5).when(F.trim(known) == F.trim(patch), 1.0).otherwise(0.3)
    names = F.array_distinct(F.regexp_extract_all(msg, F.lit(r"\b([a-z_][a-z0-9_]*)\b"), 1))
    hits = F.size(F.filter(names, lambda x: F.contains(p, x)))
    shared = F.when(F.size(names) == 0, 0.5).when(hits > 0, 0.7 + 0.2 * hits / F.size(names)).otherwise(0.3)
    has = lambda t, *ws: [t.contains(w) for w in ws]
    any_ = lambda cs: reduce(or_, cs)
    wants_import = any_(has(msg, "import", "unresolved"))
    fit = (
        F.when(wants_import & any_(has(p, "import", "require")), 1.0).when(wants_import, 0.2)
        .when(any_(has(msg, "undefined", "cannot find")) & any_(has(p, "def ", "fn ", "function")), 0.9)
        .when(msg.contains("type") & any_(has(msg, "mismatch", "expected")) & any_(has(p, ":", "as ", "cast", "typeof")), 0.8).otherwise(0.5)
    )
    return 0.35 * memory + 0.25 * shared + 0.20 * fit + 0.20 * F.coalesce(F.least(history, F.lit(1.0)), F.lit(0.5))


def governed(now: dict[str, float], last: float | None, r, rate: float = 0.3, hysteresis: float = 0.05) -> dict[str, float]:
    """The parameters after a row of health figures: they move towards targets only when overall health has moved by more than the hysteresis since last."""
    if last is None or abs(r.overall - last) <= hysteresis:
        return now
    unstable = 1.0 - r.stability
    aim = {
        "accept_threshold": min(0.7, max(0.1, GOVERNED["accept_threshold"] + unstable * 0.2 + (1.0 - r.success_rate) * 0.15)),
        "exploration_rate": min(0.8, max(0.2, GOVERNED["exploration_rate"] + r.entropy * 0.3 + (1.0 - r.memory_rate) * 0.2)),
        "max_patch_size": min(200, max(20, GOVERNED["max_patch_size"] * (1.0 - (r.rollback_rate * 0.8 + unstable * 0.5) * 0.7))),
        "max_iterations": min(30, max(5, GOVERNED["max_iterations"] + r.trend * 5.0)),
        "rollback_limit": min(5, max(1, GOVERNED["rollback_limit"] - unstable * 2.0)),
    }
    moved = {k: now[k] + rate * (aim[k] - now[k]) for k in GOVERNED}
    return {k: float(round(v)) if k in ("max_iterations", "rollback_limit") else v for k, v in moved.items()}


def govern(df: DataFrame, key: str, order: str, rate: float = 0.3, hysteresis: float = 0.05) -> DataFrame:
    """Parameters after each step, from the fixed ones on; see governed.

    Each value depends on the one before it, so a key's steps are one group.  df: ``stability, success_rate, entropy, memory_rate, rollback_rate, trend, overall``.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        now, last, out = dict(GOVERNED), None, []
        for r in group.sort_values(order).itertuples():
            now, last = governed(now, last, r, rate, hysteresis), r.overall
            out.append({key: getattr(r, key), order: getattr(r, order), **now})
        return pd.DataFrame(out)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, " + ", ".join(f"{n} double" for n in GOVERNED))


@dataclass
class Cycles:
    """What is known of a run of cycles: its start, its cap, its last two cycles as (accepted, rejected, fewer findings), and why it ended.

    The rules are those of streaks.stop_reason, but the cap grows by ``step`` while cycles make progress, up to ``most``, in the first
    0.8 of the budget; and the budget ends a run by itself, so no cycle is recorded from then on.
    """

    initial: int
    began: float
    cap: int = 4
    cycle: int = 0
    errors: int = -1
    recent: tuple = ()
    reason: str | None = None
    budget: float = 240.0
    most: int = 30
    step: int = 2

    def record(self, at: float, errors: int, accepted: int, rejected: int) -> None:
        """A cycle that ended at a time (in seconds) with so many findings; accepted and rejected are its own."""
        if at - self.began >= self.budget:
            self.reason = "runtime_budget"
            return
        fell = (self.initial if self.errors < 0 else self.errors) - errors
        self.cycle, self.errors, self.recent = self.cycle + 1, errors, (*self.recent[-1:], (accepted, rejected, fell))
        self.reason = self._reason(at)

    def _reason(self, at: float) -> str | None:
        accepted, rejected, fell = zip(*self.recent, strict=True)
        if self.errors == 0:
            return "completed"
        if self.initial > 0 and self.errors > self.initial * 1.2:
            return "global_invariant"
        if self.cycle >= self.cap:
            if self.cycle >= self.most or at - self.began >= 0.8 * self.budget or not (accepted[-1] > 0 or fell[-1] > 0):
                return "max_cycles"
            self.cap = min(self.cap + self.step, self.most)
            return None
        if self.cycle < 2:
            return None
        if max(fell) < 0 and self.errors > self.initial:
            return "error_growth"
        if any(accepted):
            return None
        if not any(fell):
            return "plateau"
        if max(fell) <= 0:
            return "no_progress"
        return "reject_spike" if sum(rejected) >= 4 else None


CYCLE = "seq bigint, cycle int, cap int, stop_reason string"


def cycles(df: DataFrame, key: str = "key", budget: float = 240.0) -> DataFrame:
    """``key, seq, cycle, cap, stop_reason`` of each cycle up to the one that ends its run.

    df: ``key, seq, ts, initial, errors, accepted, rejected``; initial is that of the first row.  Each cycle's cap depends on those before, so a
    key's cycles are one group.  A cycle at or after the budget's end gives a row with the reason and the cycles so far.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for r in group.sort_values("seq").itertuples():
            at = r.us / 1e6
            state = state or Cycles(int(r.initial), at, budget=budget)
            state.record(at, int(r.errors), int(r.accepted), int(r.rejected))
            out.append({key: getattr(r, key), "seq": r.seq, "cycle": state.cycle, "cap": state.cap, "stop_reason": state.reason})
            if state.reason:
                break
        return pd.DataFrame(out)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.withColumn("us", F.unix_micros("ts")).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {CYCLE}")


def beam(candidates: DataFrame, width: int = 3, depth: int = 2) -> DataFrame:
    """The best paths of a plan search: ``plan, step, choice, gain`` per step; each step keeps the best ``width`` paths of a plan (twice as many at first).

    Paths grow by a join with the next step's choices and are cut before the next join, so at most
    width * choices rows a plan are ever formed.
    """
    paths = candidates.filter("step = 1").select("plan", F.col("choice").cast("string").alias("path"), F.col("gain").alias("total"))
    for step in range(1, depth + 1):
        best = F.row_number().over(W.partitionBy("plan").orderBy(F.desc("total"), "path"))
        paths = paths.withColumn("_n", best).filter(F.col("_n") <= (2 * width if step == 1 and depth > 1 else width)).drop("_n")
        if step < depth:
            more = candidates.filter(F.col("step") == step + 1).select("plan", "choice", "gain")
            paths = paths.join(more, "plan").select("plan", F.concat_ws(">", "path", "choice").alias("path"), (F.col("total") + F.col("gain")).alias("total"))
    return paths
