"""Fixed values of the study design: specifications, grids and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallycard.functions.select import having, ends_in, begins

# ---- fixed values -------------------------------------------------------

SEED = 38345
SUBSET_FRACTION = 1 / 6  # share of all data used in the first round
SUBSET_TRAIN = 2 / 3  # training share inside that subset
TRAIN_FRACTION = 4 / 5
N_FOLDS = 6
MIN_LEVEL_COUNT = 120  # a level must be more frequent than this
SPECIFICITY_LOSS = 0.05
REFERENCE_DATE = "2009-01-01"
EARLIEST_PLAUSIBLE_AGE = -0.75

SMOKING_LEVELS = [
    "None", "Passive Smoke as a Child", "Passive Smoke as am Adult", "Past", "Current",
]
SMOKING_USE_LEVELS = ["Never", "Past", "Current"]
REFERENCE_RACE = "White"

ITEM_LABELS = {
    "lung_hx_asthma": "asthma",
    "lung_hx_chronic_bronchitis": "bronchitis",
    "lung_hx_emphysema": "emphysema",
    "lung_hx_copd": "COPD",
    "lung_hx_allergies": "allergies",
    "lung_hx_bronchiectasis": "bronchiectasis",
    "lung_hx_aat_deficiency_self": "AAT def. (self)",
    "lung_hx_aat_deficiency_family": "AAT def. (fam.)",
    "lung_hx_family_history_copd": "COPD (fam.)",
    "liver_hx_cirrhosis": "cirrhosis",
    "liver_hx_jaundice": "jaundice",
    "liver_hx_hepatitis": "hepatitis",
    "liver_hx_liver_transplant": "liver Tx",
    "liver_hx_abnormal_liver_function_test": "abnormal LFT",
    "gender": "gender",
    "gender_Male": "male",
    "gender_Female": "female",
    "smoking_history_cigarette": "smoking history",
    "any_tobacco_exposure": "tobacco exposure",
    "smoking_use": "smoking use",
    "smoking_use_Past": "past smoking",
    "smoking_use_Current": "current smoking",
    "lung_hx_copd_emphysema_bronchitis": "COPD (incl. Em/Br)",
    "guidelines": "COPD (incl. Em/Br) / cirrhosis",
}

# item -> 1-based positions of the prototype subjects that have it
PROTOTYPE_SUBJECTS = ["1", "2", "3", "4", "5", "6", "7", "8", "A", "B", "C", "D", "X"]
PROTOTYPE_ITEMS = {
    "lung_hx_aat_deficiency_family": [6, 8],
    "liver_hx_cirrhosis": [2, 4],
    "lung_hx_chronic_bronchitis": [3],
    "lung_hx_emphysema": [1, 2, 5, 9, 11],
    "lung_hx_bronchiectasis": [2],
    "liver_hx_hepatitis": [],
    "liver_hx_abnormal_liver_function_test": [4, 12],
    "lung_hx_allergies": [3, 6, 7, 10],
    "liver_hx_jaundice": [],
    "lung_hx_asthma": [7],
    "lung_hx_copd": [3, 5, 6],
    "lung_hx_family_history_copd": [1, 2, 6, 7, 8, 10, 11],
    "smoking_use_Past": [1, 5, 8, 9, 10],
    "smoking_use_Current": [2, 4, 7, 11],
}

PENALTIES = [1e-10, 1e-8, 1e-6, 1e-4, 1e-2, 1.0]
TREES = [1, 3, 10, 32, 100]
NEIGHBORS = [10, 100, 1000]
KERNELS = ["rectangular", "triangular"]
CARD_BOUNDS = [6, 21, 36]
CARD_TERMS_LOW = 5
FINAL_PENALTIES = [1e-4, 1e-2]
FINAL_BOUNDS = [6, 25, 100]
FINAL_TERMS = [7, 10]

# ---- specifications -----------------------------------------------------

_history = [begins("lung_"), begins("liver_")]

PREDICTORS = {
    "Dx": _history,
    "Dx+smoke hx": [having("smoking_hx"), *_history],
    "Dx+smoke use": [having("smoking_use"), *_history],
    "Dx+gender": [having("gender"), *_history],
}

NOT_PREDICTORS = [ends_in("_none")]


def responses(genotype: str = "genotype") -> dict[str, Column]:
    """Response name -> boolean test; NULL genotype stays NULL."""
    g = F.col(genotype)
    return {
        "ZZ": g == "ZZ",
        "SZ": (g == "SZ") | (g == "ZZ"),
        "Ab": g != "MM",
    }


def mtry_grid(n_predictors: int) -> list[int]:
    """Candidate numbers of predictors per split, from the number of predictors."""
    return sorted({
        round(n_predictors ** (1 / 3)),
        round(n_predictors ** 0.5),
        n_predictors // 2,
    })


# model name -> family
MODEL_TYPES = {
    "logistic regression": "generalized linear",
    "linear discriminant": "generalized linear",
    "decision rules": "rule/tree-based",
    "decision tree": "rule/tree-based",
    "random forest": "rule/tree-based",
    "nearest neighbor": "distance-based",
    "linear svm": "kernel-based",
    "quadratic svm": "kernel-based",
    "cubic svm": "kernel-based",
}
