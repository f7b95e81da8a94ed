"""Time the materialisations and the query itself: python dev/timing.py SF name ..."""
import sys, time
from pathlib import Path
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from vintara import plans, session
import vintara.session
spark = session.local_session(); spark.sparkContext.setLogLevel("ERROR")
import importlib, pkgutil
orig = session.materialize
def timed(df, name, *a, **k):
    t = time.time(); out = orig(df, name, *a, **k); print(f"      {name:22s} {time.time()-t:6.2f}s", flush=True); return out
for m in list(sys.modules.values()):
    if getattr(m, "__name__", "").startswith("vintara") and getattr(m, "materialize", None) is orig:
        m.materialize = timed
sf = sys.argv[1]
for n in sys.argv[2:]:
    for i in range(2):
        t = time.time(); df = plans.queries()[n](spark, sf); t1 = time.time()
        df.write.format("noop").mode("overwrite").save()
        print(f"{n} build {t1-t:.2f}s run {time.time()-t1:.2f}s", flush=True)
