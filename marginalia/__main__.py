import sys

from .api import main

sys.exit(main(sys.argv[1:]))
