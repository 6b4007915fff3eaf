"""Column expressions: no shuffles, no Python workers, all inside whole-stage codegen."""
