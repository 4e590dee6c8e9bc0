from tessera.functions.scalar import avg_truncated, compare, family, int_divide, int_modulo, kind_of, negate, null_safe_predicate

__all__ = ["avg_truncated", "compare", "family", "int_divide", "int_modulo", "kind_of", "negate", "null_safe_predicate"]
