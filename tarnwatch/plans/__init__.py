"""plans of the station analytics library."""
