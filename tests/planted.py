"""Generated tables with known effects, for fits the driver tables carry no signal for."""

import datetime as dt

import numpy as np
import pandas as pd

FEATURES = ["a", "b", "c", "d", "e"]
EFFECTS = {"a": 1.6, "b": -1.2, "c": 0.8, "d": 0.0, "e": 0.0}
INTERCEPT = -1.5


def flags(n=6000, seed=7):
    """Yes/no features with planted log odds; returns a pandas table."""
    rng = np.random.default_rng(seed)
    x = {f: rng.random(n) < p for f, p in zip(FEATURES, (0.3, 0.5, 0.4, 0.6, 0.05))}
    eta = INTERCEPT + sum(EFFECTS[f] * x[f] for f in FEATURES)
    event = rng.random(n) < 1 / (1 + np.exp(-eta))
    return pd.DataFrame({"record_id": np.arange(n), **x, "is_event": event})


HISTORY = [
    "Lung Disease History (choice=Asthma)", "Lung Disease History (choice=Chronic Bronchitis)",
    "Lung Disease History (choice=Emphysema)", "Lung Disease History (choice=COPD)",
    "Lung Disease History (choice=AAT Deficiency Self)", "Lung Disease History (choice=None)",
    "Liver Disease History (choice=Cirrhosis)", "Liver Disease History (choice=Liver Transplant)",
]


def raw_cohort(n=4000, seed=3):
    """A raw text table: check boxes, yes/no, dates, categories, and edge rows."""
    rng = np.random.default_rng(seed)
    box = {h: np.where(rng.random(n) < 0.3, "Checked", "Unchecked") for h in HISTORY}
    copd, emph, cirr = (box[HISTORY[i]] == "Checked" for i in (3, 2, 6))
    smoking = rng.choice(["None", "Passive Smoke as a Child", "Past", "Current", "Pipe"], n, p=[0.4, 0.1, 0.25, 0.2, 0.05])
    eta = -2.2 + 1.2 * emph + 1.5 * cirr + 0.7 * (smoking == "Past") - 0.4 * copd
    zz = rng.random(n) < 1 / (1 + np.exp(-eta))
    other = rng.choice(["MM", "MZ", "SZ"], n, p=[0.7, 0.2, 0.1])
    genotype = np.where(zz, "ZZ", other).astype(object)
    genotype[:3] = None
    genotype[3:8] = "IZ"  # too rare to be kept
    birth = [dt.date(1940, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 20000, n)]
    got = [dt.date(2004, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 2500, n)]
    birth[10], got[10] = dt.date(2009, 5, 1), dt.date(2005, 5, 1)  # reversed
    birth[11] = dt.date(1960, 2, 29)
    text = lambda days: [d.strftime("%m/%d/%Y") for d in days]
    return pd.DataFrame({
        "Record ID": np.arange(n), "Genotype": genotype, "Genotype Simple": genotype, "AAT Level": rng.random(n).round(3),
        "Gender": rng.choice(["Female", "Male", "(Missing)"], n, p=[0.5, 0.45, 0.05]),
        "Date Received": text(got), "Date of Birth": text(birth),
        "Age Calculated": np.where(rng.random(n) < 0.5, rng.random(n) * 80, np.nan),
        "Smoking History Cigarette": smoking,
        "Any Tobacco Exposure": rng.choice(["Yes", "No"], n),
        "Physician Specialty": rng.choice(["0", "Allergist/Immunologist", "Family"], n),
        **box,
    })
