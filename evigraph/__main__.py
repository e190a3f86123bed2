import sys

from evigraph.cli import main

sys.exit(main())
