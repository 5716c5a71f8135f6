"""DataFrame operators of the valuary library."""
