"""Column -> Column expressions. No Python UDFs: everything is JVM-side."""

from .features import (display_features, engineered_features, exclamation_count,
                       feature_values, has_account_words, has_any, has_payment_words,
                       has_urgent_words, link_count, uppercase_ratio)
from .message import (base_domain, compose_text, default_message_id,
                      default_subject, message_body, sender_domain, serving_text)
from .scores import (attribution_sentence, clamp_confidence, predicted_label,
                     rule_reasons, sigmoid)
from .text import (analyse, clean_text, drop_stop_words, ngrams, normalise_label,
                   strip_html, strip_ws, tokens, with_term_counts)

__all__ = [n for n in dir() if not n.startswith("_")]
