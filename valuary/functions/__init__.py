"""Column expressions of the valuary library."""
