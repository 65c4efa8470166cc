"""Per-listing metrics as Column expressions over one wide row per listing."""
