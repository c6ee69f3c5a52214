"""Daily micro-batch refresh of the feature block (the reference itself is batch only)."""
