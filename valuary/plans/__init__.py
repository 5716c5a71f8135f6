"""End-to-end plans of the valuary library."""
