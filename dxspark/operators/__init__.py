"""DataFrame operators: reshape/filters (B, C), lookups (D, F1), aggregates and
order (E, F, G), code jobs (I), features (J), metrics and models (K),
explanations (L), graph and areas (M, N), plus the range-bucket ordering helper."""
