"""Numbers the model is defined by, in one place."""

# Needed as they are for matching results.
MIN_DOCUMENT_LENGTH = 2        # documents below this many tokens add no co-occurrences
INITIAL_VARIANCE = 20.0        # diagonal of the first prior covariance
SMALLEST_DOUBLE = 5e-324       # topic probability of a term without co-occurrences
SIMPLEX_STEP = 100.0           # step of the exponentiated gradient, doubled in the update
SIMPLEX_TOLERANCE = 1e-27      # allowed change of the root of the squared gradient
SIMPLEX_ROUNDS = 499           # most updates per term
RIDGE_TOLERANCE = 1e-4         # allowed total change of the coefficients

# Own settings of this package.
SIMPLEX_SLACK = 1e-16          # rise of the squared error taken for rounding
TIE_DIGITS = 12                # norms equal to this many decimals count as equal
RIDGE_ROUNDS = 1000            # cap on the coefficient updates; reaching it warns
SMALLEST_NORMAL = 2.2250738585072014e-308  # floor for a probability before log or division
NEWTON_ROUNDS = 100            # cap on Newton steps per document; one that reaches it is reported
LARGE_TOPICS = 50              # with more topics logits are found by a limited memory of past steps
LIMITED_MEMORY = 8             # past steps remembered
LIMITED_ROUNDS = 1000          # cap on these steps; a document that reaches it is reported
