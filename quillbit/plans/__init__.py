"""Plans: model specifications, scoring drivers, storage of intermediate tables."""
