import sys

from seekstone.cli import main

sys.exit(main())
