"""Plans: size checks, registries and the bindings of operators to the driver tables."""
