"""Confidence, rule reasons and explanation sentences (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clamp_confidence(margin: Column | str) -> Column:
    """Margin-only models: clamp((m + 3) / 6, 0, 1) as phishing confidence."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_c(margin) + 3.0) / 6.0))


def sigmoid(margin: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(margin)))


def predicted_label(margin: Column | str) -> Column:
    """Class 1 (phishing) only when its score is strictly greater."""
    return F.when(_c(margin) > 0, F.lit(K.PHISHING)).otherwise(F.lit(K.LEGITIMATE))


def rule_reasons(prediction: Column | str, trusted: Column | str, feats: Column | str) -> Column:
    """Ordered human-readable reasons; `feats` is the display struct."""
    f = _c(feats)
    t = _c(trusted)
    phishing = F.array_compact(F.array(
        F.when(~t, F.lit(K.REASON_UNTRUSTED)),
        F.when(f["link_count"] > 0, F.lit(K.REASON_LINKS)),
        F.when(f["has_urgent_words"], F.lit(K.REASON_URGENT)),
        F.when(f["has_account_words"], F.lit(K.REASON_ACCOUNT)),
        F.when(f["has_payment_words"], F.lit(K.REASON_PAYMENT)),
        F.when(f["exclamation_count"] > K.EXCLAMATION_LIMIT, F.lit(K.REASON_EXCLAIM)),
        F.when(f["uppercase_ratio"] > K.UPPERCASE_LIMIT, F.lit(K.REASON_UPPER)),
    ))
    phishing = F.when(F.size(phishing) > 0, phishing).otherwise(F.array(F.lit(K.REASON_FALLBACK)))
    legitimate = F.array_compact(F.array(
        F.lit(K.REASON_NO_INDICATORS),
        F.when(t, F.lit(K.REASON_TRUSTED)),
        F.lit(K.REASON_SAFE_LANGUAGE),
    ))
    return F.when(_c(prediction) == K.PHISHING, phishing).otherwise(legitimate)


# --- fixed values: explanation sentences ----------------------------------
LINEAR_SENTENCES = {
    K.PHISHING: ("SHAP found the strongest phishing contribution from: ",
                 "SHAP did not find strong positive phishing driving features for this email."),
    K.LEGITIMATE: ("SHAP found the strongest safe email contribution from: ",
                   "SHAP did not find strong positive safe email driving features for this email."),
}
SURROGATE_SENTENCES = {
    K.PHISHING: ("this email was flagged as phishing because the model found suspicous language such as: ",
                 "This email was flagged as phishing becuase the model found language patterns associated with phishing emails."),
    K.LEGITIMATE: ("This email was marked as legitimate becuase the model found more normal looking language such as: ",
                   "This email was marked as legitimate becuase the model found language patterns more consistent with safe emails."),
}
SURROGATE_TOO_SHORT = "This email did not contain enough text for a detailed AI explanation."


def attribution_sentence(features: Column | str, prediction: Column | str,
                         sentences: dict = LINEAR_SENTENCES) -> Column:
    """Up to four positively weighted feature names, in list order."""
    names = F.transform(F.filter(_c(features), lambda x: x["weight"] > 0), lambda x: x["feature"])
    quoted = F.array_join(F.slice(names, 1, K.SENTENCE_TOP), ", ")
    p = _c(prediction)

    def sentence(cls):
        lead, fallback = sentences[cls]
        return F.when(F.size(names) > 0, F.concat(F.lit(lead), quoted, F.lit("."))).otherwise(F.lit(fallback))

    return F.when(p == K.PHISHING, sentence(K.PHISHING)).otherwise(sentence(K.LEGITIMATE))
